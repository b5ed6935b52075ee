from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np

from lexloom.llm import components, exact_dedup, fuse_filter, line_dedup, near_dedup, substring_dedup, words
from tests.llm.fixtures import frame, odd_rows, same, sample_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_fuse_filter_holds_members_and_few_others():
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    for n in (0, 1, 2, 3, 50, 20_000):
        blob = fuse_filter.build(keys[:n])
        assert fuse_filter.contains(blob, keys[:n]).all()
        assert fuse_filter.contains(blob, keys + np.uint64(1)).mean() < 0.01
    assert len(fuse_filter.build(keys)) < 1.25 * len(keys)


def brute_exact(rows):
    out, groups = [], collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    for bare, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], best[0], len(members), r[0] == best[0] and len(r[1] or "") == len(best[1] or ""), sha(bare)) for r in members]
    return out


def test_exact_dedup(spark):
    rows = sample_rows() + odd_rows()
    same(exact_dedup.dedup(frame(spark, rows, clash=True)).collect(), brute_exact(rows))
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_exact_dedup_kept_documents_keep_columns(spark):
    rows = sample_rows() + odd_rows()
    docs = frame(spark, rows, clash=True)
    kept = exact_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in {(r[1], r[4]): r[1] for r in brute_exact(rows)}.values())


def test_exact_dedup_of_null_and_repeated_ids(spark):
    rows = [(1, "A", "en", "s", 1), (1, "A", "en", "s", 1), (5, "B", "en", "s", 1), (5, "C", "en", "s", 1), (6, "B  ", "en", "s", 3), (None, "D", "en", "s", 1), (None, "E", "en", "s", 1), (None, "E", "fr", "s", 1), (7, "E", "en", "s", 1)]
    rows += [(8, "x y", "en", "s", 3), (8, "x\ty", "en", "s", 3)]
    same(exact_dedup.dedup(frame(spark, [r for r in rows if r[0] != 8])).collect(), brute_exact([r for r in rows if r[0] != 8]))
    found = exact_dedup.kept_documents(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in found if r.doc_id != 8) == [(0, "D"), (1, "A"), (5, "C"), (6, "B  "), (7, "E")]
    assert sum(r.doc_id == 8 for r in found) == 1


def test_exact_dedup_compares_bytes_of_texts_in_one_bucket(spark):
    from pyspark.sql import functions as F

    docs = frame(spark, [(1, "one text", "en", "s", 8), (2, "onetext", "en", "s", 7), (3, "another", "en", "s", 7)])
    rows = exact_dedup.digests(docs)
    row = {r.doc_id: r for r in rows.collect()}
    pairs = [(1, 2, bytes([1])), (1, 3, bytes([2]))]  # as if digests of both pairs were equal
    best = lambda i: (0, False, i, row[i].tag)
    struct = "struct<o:bigint,z:boolean,id:bigint,tag:bigint>"
    candidates = spark.createDataFrame([(d, best(a), best(b)) for a, b, d in pairs], f"digest binary, best {struct}, held {struct}")
    assert [bytes(r.digest) for r in exact_dedup.same_bytes(docs, candidates).orderBy(F.col("digest")).collect()] == [bytes([1])]


def brute_classes(rows, threshold=0.8):
    shingles = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        shingles.append(collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else collections.Counter([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(shingles):
        for j in range(i):
            b = shingles[j]
            both = sum((a & b).values())
            if both and both / sum((a | b).values()) >= threshold:
                parent[find(i)] = find(j)
    classes = collections.defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(LAST if r[0] is None else r[0])
    real = lambda x: None if x == LAST else x
    return [(r[0], real(min(classes[find(i)])), len(classes[find(i)])) for i, r in enumerate(rows)]


def classes_of(df):
    return [(r.doc_id, r.class_id, r.class_size) for r in df.collect()]


def test_near_dedup_against_all_pairs(spark):
    rows = sample_rows(n=30) + odd_rows()
    docs = frame(spark, rows, clash=True)
    want = brute_classes(rows)
    same(classes_of(near_dedup.near_classes(docs)), want)
    assert len({c for _, c, _ in want}) < len(want) - 5
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    worded = [(r.doc_id, r.text) for r in kept.collect() if (r.text or "").strip()]
    classes = collections.Counter(c for (_, c, _), r in zip(want, rows, strict=True) if (r[1] or "").strip())
    assert sorted(str(i) for i, _ in worded) == sorted(map(str, classes))


def test_near_dedup_of_null_and_repeated_ids(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(90)) for _ in range(4)]
    edited = [t.replace(" ", " new ", 1) for t in texts]
    rows = [(None, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (None, texts[1], "en", "s", 0), (3, texts[2], "en", "s", 0), (3, texts[3], "en", "s", 0), (9, edited[0], "en", "s", 0), (2, edited[2], "en", "s", 0), (3, edited[3], "en", "s", 0)]
    docs = frame(spark, rows)
    same(classes_of(near_dedup.near_classes(docs)), brute_classes(rows))
    kept = [(r.doc_id, r.text) for r in near_dedup.kept_documents(docs).collect()]
    assert len(kept) == 4 and (9, edited[0]) in kept and (None, texts[1]) in kept and (2, edited[2]) in kept
    assert sum(x in ((3, texts[3]), (3, edited[3])) for x in kept) == 1


def test_near_dedup_of_a_family_with_ever_more_edits(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(120)]
    rows = []
    for k in range(90):
        text = list(base)
        for _ in range(rnd.randint(0, 9)):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(10**9)}"
        rows.append((k, " ".join(text), "en", "s", 0))
    want = brute_classes(rows)
    same(classes_of(near_dedup.near_classes(frame(spark, rows))), want)
    assert len({c for _, c, _ in want}) > 20


def test_near_dedup_at_the_border_of_similarity(spark):
    """400 pairs of 0.80 to 0.83: none may be lost but by chance (0.0003 a pair)."""
    rnd = random.Random(21)
    rows = []
    for k in range(400):
        words_ = [f"v{rnd.randrange(10**8)}" for _ in range(104)]
        other = list(words_)
        for at in rnd.choice([(20,), (20, 60)]):
            other[at] = f"e{rnd.randrange(10**8)}"
        rows += [(2 * k, " ".join(words_), "en", "s", 0), (2 * k + 1, " ".join(other), "en", "s", 0)]
    found = near_dedup.near_classes(frame(spark, rows)).filter("class_size = 2").count()
    assert found >= 798


def test_near_dedup_prefixes_hold_few_of_the_common_elements(spark):
    """100 sets of 200 common elements and 20 of their own: a prefix of 45 takes the own ones and the first 25 common ones."""
    pack = lambda xs: b"".join(int(x).to_bytes(5, "little") for x in sorted(xs))
    common = [7 * k + 3 for k in range(200)]
    rows = [(i, bytearray(pack(common + [10_000 + 100 * i + k for k in range(20)]))) for i in range(100)]
    sets = spark.createDataFrame(rows, "id long, units binary")
    stage, written = near_dedup.Stage(spark, "test"), {}

    class Watched:
        def write(self, df, name):
            written[name] = stage.write(df, name)
            return written[name]

    found = near_dedup._prefixes(sets, sets.select("id"), 0.8, Watched()).collect()
    assert written["units"].count() == 100 * (20 + 25)
    assert sorted((r["band"], r["id"], r["place"], r["n"]) for r in found) == sorted((x, i, 21 + k, 220) for i in range(100) for k, x in enumerate(common[:25]))


def test_near_dedup_prefixes_meet_every_similar_pair(spark, monkeypatch):
    """Whatever number of elements counts as common, similar sets meet where both have enough left to share."""
    rnd = random.Random(11)
    pack = lambda xs: b"".join(int(x).to_bytes(5, "little") for x in sorted(xs))
    base = rnd.sample(range(1 << 30), 60)
    sets = {i: {x if rnd.random() > 0.08 else rnd.randrange(1 << 30) for x in base} for i in range(120)}
    df = spark.createDataFrame([(i, bytearray(pack(s))) for i, s in sets.items()], "id long, units binary")
    like = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert like
    for most in (0, 7, 10_000):
        monkeypatch.setattr(near_dedup, "COMMON", most)
        groups = collections.defaultdict(list)
        for r in near_dedup._prefixes(df, df.select("id"), 0.8, near_dedup.Stage(spark, "test")).collect():
            groups[r["band"]].append(r)
        left = lambda x, y: 1 + min(x["n"] - x["place"], y["n"] - y["place"])
        met = {(x["id"], y["id"]) for g in groups.values() for x in g for y in g if x["id"] < y["id"] and left(x, y) >= 0.8 / 1.8 * (x["n"] + y["n"]) - 1e-6}
        assert like <= met


def test_components_of_a_chain_in_the_order_of_ids(spark):
    from lexloom.llm.components import components
    from lexloom.llm.support import Stage

    stage = Stage(spark, "test-components")
    names, write = [], stage.write
    stage.write = lambda df, name: (names.append(name), write(df, name))[1]
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (501, 502), (500, 502), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in components(edges, stage, "c").collect()}
    assert found == {i: 0 for i in range(301)} | {500: 500, 501: 500, 502: 500}
    assert sum("sent" in x for x in names) <= 14


def test_smallest_node_of_each_component():
    rnd = random.Random(23)
    for n in (0, 1, 40, 400):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n)] + [(1000 + i, 999 + i) for i in range(n)] + [(5000, 5000 - i) for i in range(1, n)]
        label = {x: x for edge in edges for x in edge}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
            if all(label[a] == label[b] for a, b in edges):
                break
        found = components.smallest(*(np.array(side, np.int64) for side in (list(zip(*edges, strict=True)) or [(), ()])))
        assert dict(zip(*(x.tolist() for x in found), strict=True)) == label


def test_near_dedup_by_shuffles_alone_and_with_few_tables(spark, monkeypatch):
    """Small tables go out whole and one task solves their links; above the limits all is shuffled, and the classes are the same."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10_000)}" for _ in range(200)]
    texts = []
    for _ in range(90):
        base[rnd.randrange(len(base))] = f"new{rnd.randrange(10_000)}"
        texts.append(" ".join(base))
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)] + [(1000 + r[0], *r[1:]) for r in sample_rows(6, 10)]
    written, write = [], near_dedup.Stage.write
    monkeypatch.setattr(near_dedup.Stage, "write", lambda self, df, name: (written.append(name), write(self, df, name))[1])
    light = sorted(classes_of(near_dedup.near_classes(frame(spark, rows))))
    assert light == sorted(brute_classes(rows))
    assert not [x for x in written if re.search("sent|edges|holders-[^2]", x)]
    for limit in ("LIGHT", "SOLVED"):
        monkeypatch.setattr(near_dedup, limit, 0)
    written.clear()
    assert sorted(classes_of(near_dedup.near_classes(frame(spark, rows)))) == light
    assert [x for x in written if "sent" in x] and not [x for x in written if "solved" in x]
    monkeypatch.setattr(near_dedup, "SOLVED", 60)  # the last edges of each round
    written.clear()
    assert sorted(classes_of(near_dedup.near_classes(frame(spark, rows)))) == light
    assert [x for x in written if "rest" in x or "solved" in x]


def test_near_dedup_empty(spark):
    assert near_dedup.near_classes(frame(spark, [])).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    rnd = np.random.default_rng(5)
    for share in (0.5, 0.8):
        common = int(400 * 2 * share / (1 + share))
        both = rnd.integers(0, 2**63, common).astype(np.uint64)
        a, b = (np.r_[both, rnd.integers(0, 2**63, 400 - common).astype(np.uint64)] for _ in range(2))
        s = near_dedup.dart_sketches(np.r_[np.zeros(400, int), np.ones(400, int)], np.r_[words.mix(a), words.mix(b)], 2, k=1024)
        assert abs((s[0] == s[1]).mean() - share) < 0.06


def brute_substring(rows):
    by_id = collections.defaultdict(set)
    texts = [(LAST if r[0] is None else r[0], WORD.findall(r[1] or "")) for r in rows]
    for i, w in texts:
        for k in range(len(w) - 12):
            by_id[tuple(w[k : k + 13])].add(i)
    out = []
    for i, w in texts:
        gone = {k + j for k in range(len(w) - 12) if min(by_id[tuple(w[k : k + 13])]) < i for j in range(13)}
        out.append((None if i == LAST else i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def test_substring_dedup_against_all_windows(spark):
    rnd = random.Random(9)
    rows = sample_rows(2) + odd_rows()
    small = ["a", "b", "a a a", "c"]
    rows += [(1000 + k, " ".join(rnd.choice(small) for _ in range(rnd.randint(0, 60))), "en", "src0", 0) for k in range(60)]
    same(substring_dedup.removed_words(frame(spark, rows, clash=True)).collect(), brute_substring(rows))
    assert substring_dedup.removed_words(frame(spark, [])).count() == 0


def test_substring_dedup_texts(spark):
    rows = sample_rows(2)
    docs = frame(spark, rows, clash=True)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    want = {r[0]: r for r in brute_substring(rows)}
    for r in out.collect():
        assert sha(" ".join(WORD.findall(r.text))) == want[r.doc_id][3]
        assert r.n_chars == len(r.text)


def _named(text):
    """Names and anchors of all windows of one text of word names."""
    offsets = np.array([0, len(text)])
    at = substring_dedup.window_starts(offsets)
    levels = substring_dedup.interiors(text, np.zeros(len(text), np.int64), at)
    anchor_at, anchor = substring_dedup.anchors(levels, at, words.grams(text, offsets, substring_dedup.PHRASE)[0])
    assert ((anchor_at >= at) & (anchor_at + substring_dedup.PHRASE <= at + substring_dedup.WINDOW)).all()
    return substring_dedup.signatures(levels, at), anchor, levels


def test_windows_have_the_name_and_anchor_of_their_words_alone():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 3, 6, 500):
        pool = rnd.integers(0, 2**63, size).astype(np.uint64)
        told, deepest = {}, 0
        for _ in range(150):
            window = rnd.choice(pool, 13)
            for _ in range(3):
                text = np.r_[rnd.choice(pool, rnd.integers(0, 9)), window, rnd.choice(pool, rnd.integers(0, 9))]
                name, anchor, levels = _named(text)
                deepest = max(deepest, sum(bool((low < high).any()) for _, low, high in levels))
                for k in range(len(text) - 12):
                    told.setdefault(tuple(text[k : k + 13].tolist()), set()).add((int(name[k]), int(anchor[k])))
        assert all(len(x) == 1 for x in told.values())
        assert len({x for s in told.values() for x, _ in s}) == len(told)
        assert deepest == (3 if size > 3 else deepest)


def test_substring_dedup_of_null_and_repeated_ids(spark):
    rnd = random.Random(3)
    passage, other = (" ".join(f"p{rnd.randrange(10**6)}" for _ in range(40)) for _ in range(2))
    rows = [(5, passage, "en", "s", 0), (5, f"x {other}", "en", "s", 0), (5, f"x {other}", "en", "s", 0), (None, f"a b {passage}", "en", "s", 0), (None, f"c {other} d", "en", "s", 0), (None, "short", "en", "s", 0)]
    rows += [(2, other[:200], "en", "s", 0)] + [(100 + k, passage, "en", "s", 0) for k in range(50)]
    docs = frame(spark, rows)
    same(substring_dedup.removed_words(docs).collect(), brute_substring(rows))
    texts = collections.Counter((r.doc_id, sha(" ".join(WORD.findall(r.text)))) for r in substring_dedup.without_repeats(docs).collect())
    assert texts == collections.Counter((r[0], r[3]) for r in brute_substring(rows))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, base, edits):
    x = list(base)
    for _ in range(edits):
        i = rnd.randrange(len(x) + 1)
        x[i : i + rnd.randint(0, 1)] = rnd.choice([[], ["z"], ["q"]])
    return "".join(x)


def check_lines(found, occurrences):
    """Every row against all pairs: classes are the components, links are true and no more than there are."""
    lines = sorted(occurrences)
    assert sum(r.n_rows for r in found) == sum(occurrences.values()) and len(found) == len(lines)
    near = {i: {j for j, b in enumerate(lines) if i != j and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2} for i, a in enumerate(lines)}
    label, left = {}, set(near)
    while left:
        first = min(left)
        todo = [first]
        left.discard(first)
        while todo:
            i = todo.pop()
            label[i] = first
            new = left & near[i]
            left -= new
            todo += new
    by_line = {}
    for r in found:
        by_line[r.line_id] = r
    import xxhash

    row = [by_line[xxhash.xxh64(x.encode(), seed=42).intdigest() - (2**64 if xxhash.xxh64(x.encode(), seed=42).intdigest() >= 2**63 else 0)] for x in lines]
    least = collections.defaultdict(list)
    for i, r in enumerate(row):
        least[label[i]].append(r.line_id)
    assert [r.class_id for r in row] == [min(least[label[i]]) for i in range(len(lines))]
    assert all(r.kept == (r.class_id == r.line_id) and r.n_chars == len(x) and r.n_rows == occurrences[x] for r, x in zip(row, lines, strict=True))
    assert all((r.n_links > 0) == bool(near[i]) and r.n_links <= len(near[i]) for i, r in enumerate(row))
    return row, near


def strip(x):
    return x.strip(" \t\n\x0b\x0c\r")


def test_line_dedup_against_all_pairs(spark):
    rnd = random.Random(4)
    lines = {"Th the anhely eran.", "Than the anhely eran.", "a" * 47 + "b", "a" * 47, "naïve 😀", "naive 😀!"}
    for n in [*range(5, 60, 2), *range(60, 90, 5)]:
        base = strip("".join(rnd.choice("abcé deghij") for _ in range(n))) or "q"
        lines |= {strip(edited(rnd, base, rnd.randint(0, 3))) for _ in range(4)} - {""}
    lines = sorted(lines)
    rows = [(i, f" {a}\n\n{b}\t\x0b", "en", "s", 0) for i, (a, b) in enumerate(zip(lines, reversed(lines), strict=True))]
    odd = [r for r in odd_rows() if r[0] != 7]
    found = line_dedup.line_classes(frame(spark, rows + odd, clash=True)).collect()
    occurrences = collections.Counter(y for r in rows + odd for x in (r[1] or "").split("\n") if (y := strip(x)))
    row, near = check_lines(found, occurrences)
    large = [i for i, x in enumerate(sorted(occurrences)) if len(x) > 6]
    assert all(row[i].n_links == len(near[i]) for i in large)  # no family here is large
    assert line_dedup.line_classes(frame(spark, [])).count() == 0


def test_line_dedup_of_tiny_lines_and_large_families(spark, tmp_path):
    from lexloom.llm import queries

    rnd = random.Random(14)
    lines = {"a", "b", "é", "ab", "cd", "xaby", "😀", "12", "123"} | {f"{k}" for k in range(60)} | {f"n{k}" for k in range(100, 160)}
    base = "".join(rnd.choice("abcdefgh é") for _ in range(60)).strip()
    lines |= {strip(edited(rnd, base, rnd.randint(0, 4))) for _ in range(200)}
    chain = "0" * 45
    lines |= {"x" * k + "y" * (60 - k) for k in range(0, 61, 2)} | {f"{chain}{k:06d}" for k in range(0, 40)} | {f"{chain}{rnd.randrange(10**6):06d}" for k in range(60)}
    lines = sorted(lines)
    frame(spark, [(i, x, "en", "s", len(x)) for i, x in enumerate(lines)]).write.parquet(f"{tmp_path}/documents.parquet")
    check_lines(queries.op9_line_dedup(spark, str(tmp_path)).collect(), collections.Counter(lines))


def test_line_dedup_counts_all_links_of_a_crowded_segment(spark):
    rnd = random.Random(18)
    base = "".join(rnd.choice("abcdefgh é") for _ in range(60)).strip()
    lines = sorted({strip(edited(rnd, base, rnd.randint(0, 3))) for _ in range(150)} | {f"n{k}" for k in range(100, 160)} | {"0" * 45 + f"{k:06d}" for k in range(0, 60)})
    found = line_dedup.line_classes(frame(spark, [(i, x, "en", "s", 0) for i, x in enumerate(lines)])).collect()
    row, near = check_lines(found, collections.Counter(lines))
    assert [row[i].n_links for i in range(len(lines))] == [len(near[i]) for i in range(len(lines))]


def test_line_dedup_of_an_ordered_chain(spark):
    lines = ["x" * k + "y" * (500 - k) for k in range(0, 500, 2)]
    found = line_dedup.line_classes(frame(spark, [(i, x, "en", "s", 0) for i, x in enumerate(lines)])).collect()
    assert len({r.class_id for r in found}) == 1 and sum(r.kept for r in found) == 1


def test_band_distance_equals_levenshtein(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(3, 30)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 1)] = rnd.choice([[], ["b"], ["c"]])
        a, b = sorted((a, "".join(b)), key=len)
        if len(b) - len(a) <= 2 and a:
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "x string, y string")
    want = F.least(F.levenshtein("x", "y"), F.lit(3))
    assert df.filter(line_dedup.band_distance(F.col("x"), F.col("y")) != want).count() == 0


def test_line_dedup_plan_is_native(spark, capsys):
    df = line_dedup.line_classes(frame(spark, sample_rows()))
    df.explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
