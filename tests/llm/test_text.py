from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm import packing, quality_rules, token_counts, unigram
from tests.llm.fixtures import frame, odd_rows, prose, sample_rows

ALPHABET = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", " ", " ", "　", "\x1c", "\x85", "1", "٣", "!", "?", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "漢", "́", "İ", "ΑΣ", "👍", "the", "aaa", "\r\n", "\x00", "<|end", "▁"]


def noise(n: int, seed: int = 2) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counter = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in noise(4000):
        assert counter.count(text.encode()) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    rows = sample_rows() + odd_rows()
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    found = token_counts.count_tokens(frame(spark, rows, clash=True)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def test_word_ids_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words = packing.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in noise(4000, 3):
        assert words.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_encoder_forgets_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "KEPT_WORDS", 10)
    words = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(30):
        text = " ".join(f"w{(k * 7 + j) % 90}" for j in range(20))
        assert words.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [r for r in sample_rows() + odd_rows() if r[0] != 4]
    found = packing.pack(frame(spark, rows, clash=True), with_ids=True).collect()
    pieces = {}
    for p in found:
        assert p.length == len(p.ids) and p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        pieces.setdefault(p.doc_id, []).append(p)
    assert len({p.sequence_id for p in found}) == len(found)
    for r in rows:
        if r[0] is not None:
            own = sorted(pieces[r[0]], key=lambda p: p.start)
            ids = [i for p in own for i in p.ids]
            assert ids == [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
            assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
            assert all(p.doc_tokens == len(ids) for p in own)
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_buckets_are_neighbours(spark):
    found = packing.pack(frame(spark, sample_rows())).orderBy("sequence_id").collect()
    lengths = [p.length for p in found]
    assert lengths == sorted(lengths)


def test_decompose():
    for n in (1, 2, 3, 2047, 2048, 2049, 6000):
        parts = packing.decompose(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True)


@pytest.fixture(scope="module")
def coder():
    return unigram.unigram(public_tokenizers.path("piece_bpe_32k.model"))


def test_unigram_paths_are_best(coder):
    score = {coder.pieces[i].decode(): s for i, s in zip(coder.ids.tolist(), coder.score.tolist(), strict=True)}
    by_id = dict(zip(coder.ids.tolist(), coder.score.tolist(), strict=True))
    rnd = random.Random(8)
    for _ in range(600):
        text = "".join(rnd.choice(["a", "b", "the", "ing", " ", "  ", "é", "中", "ation", ".", "1", "Q"]) for _ in range(rnd.randint(1, 12)))
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(marked)
        for a in range(len(marked)):
            for b in range(a + 1, min(len(marked), a + 16) + 1):
                if marked[a:b] in score:
                    best[b] = max(best[b], best[a] + score[marked[a:b]])
        ids = coder.encode(text)
        assert abs(sum(by_id[i] for i in ids) - best[-1]) < 1e-6
        assert coder.decode(ids) == text


def test_unigram_round_trip(spark, coder):
    for text in noise(1500, 5):
        if "▁" not in text:
            assert coder.decode(coder.encode(text)) == text
    rows = sample_rows() + odd_rows()
    encoded = unigram.encode_documents(frame(spark, rows, clash=True), with_ids=True)
    assert encoded.filter("not round_trip").count() == 0
    texts = sorted((r.doc_id or 0, r.text) for r in unigram.decode_documents(encoded.select("doc_id", "ids")).collect())
    assert texts == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert unigram.encode_documents(frame(spark, [])).count() == 0


def test_trie_finds_its_keys_only():
    rnd = random.Random(1)
    keys = sorted({bytes(rnd.choice(b"abc\xff\x00") for _ in range(rnd.randint(1, 6))) for _ in range(300)})
    trie = unigram.DoubleArray(keys)

    def look(key):
        state = np.zeros(1, np.int32)
        for b in key:
            state, ok = trie.step(state, np.array([b], np.uint8))
            if not ok[0]:
                return -1
        return int(trie.value[state[0]])

    assert [look(k) for k in keys] == list(range(len(keys)))
    assert all(look(k + b"z") == -1 for k in keys)


def _as_unigram(path, change=None):
    """The installed model as a unigram model, its unranked white-space pieces unused, written to path."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        if piece.type == 1 and piece.score <= unigram.UNRANKED:
            piece.type = 5
    if change:
        change(model)
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_unigram_ids_and_columns_equal_the_library(spark, tmp_path):
    import sentencepiece

    path = _as_unigram(tmp_path / "uni.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sample_rows() + odd_rows() + [(2000 + k, t, "en", "s", 0) for k, t in enumerate(noise(400)) if "\x00" not in t and "▁" not in t]
    found = unigram.encode_documents(frame(spark, rows), model=path, with_ids=True).collect()
    want = [(r[0], library.encode(r[1] or "")) for r in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=key) == sorted(want, key=key)
    for r in found:
        assert r.n_pieces == len(r.ids) and r.n_byte_pieces == sum(library.is_byte(i) for i in r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_unigram_refuses_models_it_would_encode_wrongly(tmp_path):
    def odd_piece(model):
        model.pieces[400].piece = "a▁b"

    def lower(model):
        model.normalizer_spec.remove_extra_whitespaces = True

    for k, change in enumerate((odd_piece, lower)):
        with pytest.raises(ValueError):
            unigram.Unigram(_as_unigram(tmp_path / f"{k}.model", change))


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j + k for at in windows.values() if len(at) > 1 for j in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_rules_base_counts(spark):
    rnd = random.Random(3)
    rows = sample_rows() + odd_rows()
    rows += [(500 + k, "".join(rnd.choice(["a", "b ", "é ", "\n", "# ", "x|y ", "\t", "one two three four five six seven eight "]) for _ in range(40)), "en", "s", 0) for k in range(80)]
    found = quality_rules.judge(frame(spark, rows, clash=True)).collect()
    want = sorted((r[0] or 0, *brute_counts(r[1])) for r in rows)
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def _outliers(rnd):
    """A text that is odd in one statistic only, by name."""
    words = lambda n: prose(rnd, n).split()
    lines = prose(rnd, 240).split("\n")
    repeat = " ".join(words(24))
    return {
        "capitals": " ".join(w.upper() for w in words(90)),
        "symbols": " ".join(w + "$$" for w in words(90)),
        "duplicate lines": "\n".join(x for i, line in enumerate(lines) for part in (line[:60], line[60:120], line[120:]) for x in (part, "Read on.")),
        "repeated words": f"{repeat} {prose(rnd, 70)} {repeat} {prose(rnd, 60)}",
        "long words": " ".join(a + b for a, b in zip(words(140), words(140))),
    }


def test_quality_rules_find_outliers_in_each_statistic_and_leave_the_rest(spark):
    rnd = random.Random(7)
    rows = [(k, prose(rnd, rnd.randint(60, 300)), "en", "src0", 0) for k in range(300)]
    odd = [(1000 + k, t, "en", "src0", 0) for k, t in enumerate(t for _ in range(5) for t in _outliers(rnd).values())]
    found = quality_rules.judge(frame(spark, rows + odd)).collect()
    assert not [r for r in found if r.doc_id >= 1000 and (r.kept or r.base_failed)]
    assert sum(r.kept for r in found if r.doc_id < 1000) >= 297


def test_quality_rules_of_small_groups(spark):
    rnd = random.Random(8)
    rows = [(k, prose(rnd, 90), "en", "src0" if k < 60 else f"s{k % 20}", 0) for k in range(100)] + [(200, prose(rnd, 80), "de", "src0", 0), (201, prose(rnd, 80), None, None, 0)]
    odd = [(300, "en", "s3"), (301, "en", "src0"), (302, "de", "src0"), (303, None, "s")]
    rows += [(i, _outliers(rnd)["symbols"], lang, source, 0) for i, lang, source in odd]
    found = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert all(r.d2 is not None for r in found.values())
    assert {i for i, r in found.items() if not r.kept and i >= 200} == {i for i, _, _ in odd}
    few = quality_rules.judge(frame(spark, rows[:20])).collect()
    assert all(r.kept and r.d2 is None for r in few)


def plain_estimate(x):
    """The estimate row by row: whole bins of distances, four starts, steps until the determinant no longer falls."""
    grain, p = quality_rules.GRAIN, x.shape[1]
    octave = lambda d2: np.floor(32 * np.log2(d2 + 2.0**-10))
    moments = lambda y: (y.mean(0), np.cov(y.T, bias=True) + np.diag(grain**2))

    def quartile(v, g, share):
        cells = np.sort(np.floor(v / (g / 8)))
        return (cells[int(np.ceil(share * len(cells))) - 1] + 0.5) * g / 8

    def far(mean, cov):
        d = x - mean
        return np.array([r @ np.linalg.inv(cov) @ r for r in d])

    low, mid, high = (np.array([quartile(x[:, j], grain[j], s) for j in range(p)]) for s in (0.25, 0.5, 0.75))
    spread = (high - low) / 1.349 + grain
    box = x[(np.abs(x - mid) <= 1.5 * spread).all(1)]
    plain = (mid, np.diag(spread**2))
    best = None
    for mean, cov in (moments(x), plain, moments(np.clip(x, mid - 2 * spread, mid + 2 * spread)), moments(box) if len(box) > p else plain):
        least = np.inf
        while True:
            bins = octave(far(mean, cov))
            mean, cov = moments(x[bins <= np.sort(bins)[int(np.ceil(quality_rules.SUBSET * len(x))) - 1]])
            size = np.linalg.slogdet(cov)[1]
            if best is None or size < best[2]:
                best = mean, cov, size
            if not size < least - 1e-9:
                break
            least = size

    def middle(mean, cov):
        bins = np.sort(octave(far(mean, cov)))
        return 2.0 ** ((bins[int(np.ceil(0.5 * len(bins))) - 1] + 0.5) / 32)

    mean, cov, _ = best
    mean, cov = moments(x[octave(far(mean, cov)) <= octave(middle(mean, cov) / quality_rules.MEDIAN * quality_rules.INNER)])
    return mean, np.linalg.inv(cov), max(middle(mean, cov) / quality_rules.MEDIAN, 1.0)


def test_quality_estimate_equals_a_plain_one_by_either_route(spark):
    rnd = np.random.default_rng(4)
    groups = {}
    for k, (n, spoilt) in enumerate([(40, 0), (300, 60), (500, 110), (64, 10)]):
        x = rnd.normal(size=(n, 5)) @ (rnd.normal(size=(5, 5)) * 0.3) + rnd.normal(size=5)
        x[:, k % 5] = np.maximum(x[:, k % 5], 0)
        x[:spoilt] += rnd.normal(size=5) * 3
        groups[f"g{k}"] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "grp string, " + ", ".join(f"{v} double" for v in quality_rules.VECTOR))
    passes = {r[0]: r for r in quality_rules._by_passes(rows.repartition(3), list(groups))}
    for g, x in groups.items():
        want = plain_estimate(x)
        for mean, inverse, wide in (quality_rules.solve(x), (np.array(passes[g][1]), np.array(passes[g][2]).reshape(5, 5), passes[g][3])):
            assert np.allclose(mean, want[0], atol=1e-6) and np.allclose(inverse, want[1], rtol=1e-6, atol=1e-6) and abs(wide - want[2]) < 1e-6


def test_quality_verdicts_do_not_depend_on_the_route(spark):
    from lexloom.llm.support import Stage, prepare

    rnd = random.Random(9)
    rows = [(k, prose(rnd, rnd.randint(15, 200)), rnd.choice(["en", "fr", None]), rnd.choice(["a", "b"]), 0) for k in range(400)]
    prepare(spark)
    stage = Stage(spark, "test-rules")
    texts = frame(spark, rows).select("doc_id", "lang", "source", "text")
    stats = stage.write(texts.mapInArrow(quality_rules._counted, quality_rules._STATS), "stats")
    small, large = ({r.doc_id: r.d2 for r in quality_rules.outlier_distances(stats, Stage(spark, f"test-{limit}"), 400, limit).collect()} for limit in (10**6, 50))
    assert small.keys() == large.keys() and all(abs(small[i] - large[i]) < 1e-6 * (1 + small[i]) for i in small)
