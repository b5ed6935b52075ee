"""Quality rules: base counts, then a robust outlier verdict for each language and source.

Counts come from one map over the texts. A document's statistics are transformed to a short
vector; each group (language and source) gets a minimum-covariance-determinant estimate. From
four starts (all rows' moments; medians with quartile spreads; moments of clipped values;
moments of the rows inside the quartile box) concentration steps run until the determinant no longer falls:
the SUBSET share of rows with the smallest distances gives the next mean and covariance.
The start that ends with the least determinant counts; its median distance is put to the chi-square's,
rows within INNER are taken once more (reweighting), and whatever lies beyond CUTOFF is rejected.

Order statistics are counted in bins (a 32nd of an octave of squared distance, an eighth of
GRAIN of a statistic), and a subset takes whole bins: so sums of bins decide, which add up in any order
and in any partitioning. GRAIN squared is added to the diagonal: what a statistic moves by a single count in a
document of a hundred words or so, so one that hardly varies doesn't turn such counts into outliers.

A group up to LIMIT rows is solved in one task; a larger one by an aggregation over all its rows
for each step, with the same functions (`partial`, `final`): the route changes, the result
doesn't. A group below MIN_GROUP judged rows has no estimate of its own; its rows are judged by
the estimate of their whole language, else of the whole table.

Defined cases: null text has no words and fails the base rule; null lang and source are
values of their own; rows under MIN_WORDS words give no estimate; where the whole table has under MIN_GROUP rows that
do, only the base rule decides; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.lines import SYMBOL, BAR, UPPER, LOWER, kinds, line_spans, repeated
from lexloom.llm.support import Stage, attach, prepare
from lexloom.llm.words import code_points, grams, mix, names, spans, strings

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8

VECTOR = ["v0", "v1", "v2", "v3", "v4"]
P = len(VECTOR)
GRAIN = np.array([0.08, 0.5, 0.35, 0.1, 0.05])
SUBSET = 0.75
MIN_GROUP = 30
#: Rows of a group that one task may hold, 40 bytes each; larger groups number a row in a million at most.
LIMIT = 1_000_000
#: Fixed values for five degrees of freedom: the chi-square's median and its 0.975 and 0.999 quantiles.
MEDIAN, INNER, CUTOFF = 4.351, 12.833, 20.515

_STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, upper double"
_UPPER = np.triu_indices(P)
_MOMENTS = 1 + P + len(_UPPER[0])


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words and the four base counts of each text, and the share of capitals among its ASCII letters."""
    data, offsets = strings(column)
    starts, ends, rows = spans(data, offsets)
    words = names(data, starts, ends)
    n = np.diff(rows)
    doc = np.repeat(np.arange(len(n)), n)
    points = np.r_[0, np.cumsum(code_points(data))]
    chars = np.r_[0, np.cumsum(points[ends] - points[starts])]
    kind = kinds(data, offsets[:-1], offsets[1:])
    l_starts, l_ends, l_rows = line_spans(data, offsets)
    l_doc = np.repeat(np.arange(len(n)), np.diff(l_rows))
    worded = np.searchsorted(starts, l_ends) > np.searchsorted(starts, l_starts)
    twin = repeated(mix(names(data, l_starts, l_ends) ^ mix(l_doc.astype(np.uint64)))) & worded
    gram, valid = grams(words, rows, WINDOW)
    at = np.flatnonzero(valid)
    _, inverse, count = np.unique(mix(gram[at] ^ mix(doc[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(step)[:-1] > 0)]
    return {
        "n_words": n,
        "word_chars": chars[rows[1:]] - chars[rows[:-1]],
        "n_symbols": kind[:, SYMBOL] + kind[:, BAR],
        "n_dup_lines": np.bincount(l_doc[twin], minlength=len(n)),
        "n_repeat_words": covered[rows[1:]] - covered[rows[:-1]],
        "upper": kind[:, UPPER] / np.maximum(kind[:, UPPER] + kind[:, LOWER], 1),
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = base_counts(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v) for v in found.values())], ["doc_id", "lang", "source", *found])


def _vector() -> list[Column]:
    """Length of words, symbols and repeated lines a hundred words, share of words in repeated windows, share of capitals."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("word_chars") / words),
        F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
        F.col("upper"),
    ]


def distances(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, inverse, d)


def octave(d2: np.ndarray | float) -> np.ndarray:
    """The bin of a squared distance."""
    return np.floor(32 * np.log2(np.asarray(d2) + 2.0**-10)).astype(np.int64)


def _binned(bins: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and the moments (count, sums, sums of products) of their rows."""
    order = np.argsort(bins, kind="stable")
    bins, x = bins[order], x[order]
    if not len(bins):
        return bins, np.zeros((0, _MOMENTS))
    head = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    rows = np.c_[np.ones(len(x)), x, x[:, _UPPER[0]] * x[:, _UPPER[1]]]
    return bins[head], np.add.reduceat(rows, head)


Question = tuple  # a kind and what it needs


def partial(question: Question, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and moments of some of a group's rows; those of all parts are summed by bin."""
    kind, *given = question
    if kind == "quartiles":
        bins = np.floor(x / (GRAIN / 8)).astype(np.int64) + (np.arange(P) << 40)
        bins, n = np.unique(bins, return_counts=True)
        return bins, np.c_[n, np.zeros((len(n), _MOMENTS - 1))]
    if kind == "clipped":
        x = np.clip(x, *given)
    elif kind == "inside":
        x = x[((x >= given[0]) & (x <= given[1])).all(1)]
    bins = octave(distances(x, *given[:2])) if kind in ("closest", "median", "within") else np.zeros(len(x), np.int64)
    return _binned(bins, x)


def moments(total: np.ndarray) -> np.ndarray:
    """Count, mean and covariance (with GRAIN squared on its diagonal), flat."""
    n = max(total[0], 1.0)
    mean = total[1 : 1 + P] / n
    cov = np.zeros((P, P))
    cov[_UPPER] = total[1 + P :] / n - np.outer(mean, mean)[_UPPER]
    cov = np.triu(cov) + np.triu(cov, 1).T + np.diag(GRAIN**2)
    return np.r_[total[0], mean, cov.ravel()]


def final(question: Question, bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The answer from a group's summed bins."""
    kind, *given = question
    order = np.argsort(bins)
    bins, rows = bins[order], rows[order]
    if kind == "quartiles":
        out = []
        for j in range(P):
            mine = (bins + (1 << 39)) >> 40 == j
            upto = np.cumsum(rows[mine, 0])
            values = (bins[mine] - (j << 40) + 0.5) * (GRAIN[j] / 8)
            out.append([values[np.searchsorted(upto, share * upto[-1])] for share in (0.25, 0.5, 0.75)])
        return np.array(out).T.ravel()
    if kind == "median":
        upto = np.cumsum(rows[:, 0])
        return np.array([2.0 ** ((bins[np.searchsorted(upto, 0.5 * upto[-1])] + 0.5) / 32)])
    if kind == "closest":
        upto = np.cumsum(rows[:, 0])
        rows = rows[: np.searchsorted(upto, np.ceil(given[2] * upto[-1])) + 1]
    elif kind == "within":
        rows = rows[bins <= octave(given[2])]
    return moments(rows.sum(0) if len(rows) else np.zeros(_MOMENTS))


def _parts(answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and logarithm of its determinant."""
    cov = answer[1 + P :].reshape(P, P)
    return answer[1 : 1 + P], np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def estimate() -> Generator[list[Question], list[np.ndarray], tuple[np.ndarray, np.ndarray, float]]:
    """A group's mean, inverse covariance and scale of distances; asks questions about its rows and is sent the answers."""
    quartiles, whole = yield [("quartiles",), ("all",)]
    low, mid, high = quartiles.reshape(3, P)
    spread = (high - low) / 1.349 + GRAIN
    clipped, inside = yield [("clipped", mid - 2 * spread, mid + 2 * spread), ("inside", mid - 1.5 * spread, mid + 1.5 * spread)]
    plain = np.r_[whole[0], mid, np.diag(spread**2).ravel()]
    best = None
    open_ = [_parts(a) for a in (whole, plain, clipped, inside if inside[0] > P else plain)]
    lowest = [np.inf] * len(open_)
    while open_:
        answers = yield [("closest", mean, inverse, SUBSET) for mean, inverse, _ in open_]
        further = []
        for k, answer in enumerate(answers):
            mean, inverse, size = _parts(answer)
            if best is None or size < best[2]:
                best = mean, inverse, size
            if size < lowest[k] - 1e-9:
                further.append(((mean, inverse, size), size))
        open_, lowest = [x for x, _ in further], [y for _, y in further]
    mean, inverse, _ = best
    (median,) = yield [("median", mean, inverse)]
    (inner,) = yield [("within", mean, inverse, float(median[0]) / MEDIAN * INNER)]
    mean, inverse, _ = _parts(inner)
    (median,) = yield [("median", mean, inverse)]
    return mean, inverse, max(float(median[0]) / MEDIAN, 1.0)


def solve(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The estimate of a group whose rows are at hand."""
    steps = estimate()
    try:
        questions = next(steps)
        while True:
            questions = steps.send([final(q, *partial(q, x)) for q in questions])
    except StopIteration as end:
        return end.value


_MODEL = "grp string, mean array<double>, inverse array<double>, wide double"


def _model_row(grp: str, found: tuple[np.ndarray, np.ndarray, float]) -> tuple:
    return grp, found[0].tolist(), found[1].ravel().tolist(), found[2]


def _in_one_task(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([_model_row(pdf["grp"].iloc[0], solve(pdf[VECTOR].to_numpy(np.float64)))], columns=["grp", "mean", "inverse", "wide"])


_SUMS = [f"m{i}" for i in range(_MOMENTS)]


def _ask(rows: DataFrame, questions: dict[str, list[Question]]) -> dict[str, list[np.ndarray]]:
    """Answers for large groups: moments by bin in each batch, summed by Spark, finished a question at a time."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1)
            for name in sorted(set(grp)):
                mine = x[grp == name]
                for k, q in enumerate(questions[name]):
                    bins, sums = partial(q, mine)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(bins), pa.string()), pa.array([k] * len(bins), pa.int32()), pa.array(bins), *(pa.array(c) for c in sums.T)], ["grp", "k", "bin", *_SUMS])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        name, k = pdf["grp"].iloc[0], int(pdf["k"].iloc[0])
        answer = final(questions[name][k], pdf["bin"].to_numpy(np.int64), pdf[_SUMS].to_numpy(np.float64))
        return pd.DataFrame({"grp": [name], "k": [k], "answer": [answer.tolist()]})

    summed = rows.mapInArrow(parts, "grp string, k int, bin long, " + ", ".join(f"{m} double" for m in _SUMS)).groupBy("grp", "k", "bin").agg(*[F.sum(m).alias(m) for m in _SUMS])
    found = summed.groupBy("grp", "k").applyInPandas(finish, "grp string, k int, answer array<double>").collect()  # some 30 numbers for each of the large groups' questions
    out: dict[str, list[np.ndarray]] = {name: [np.zeros(0)] * len(q) for name, q in questions.items()}
    for r in found:
        out[r.grp][r.k] = np.array(r.answer)
    return out


def _by_passes(rows: DataFrame, names: list[str]) -> list[tuple]:
    """Estimates of large groups, all in the same passes over their rows."""
    steps = {name: estimate() for name in names}
    questions = {name: next(s) for name, s in steps.items()}
    out = []
    while questions:
        answers = _ask(rows.filter(F.col("grp").isin(list(questions))), questions)
        for name in list(questions):
            try:
                questions[name] = steps[name].send(answers[name])
            except StopIteration as end:
                out.append(_model_row(name, end.value))
                del questions[name]
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of a row with its group's mean and inverse covariance."""
    d = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    return sum((d[i] * d[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def _groups(judged: DataFrame, stats: DataFrame) -> DataFrame:
    """For each pair of language and source: its rows, the group that judges them and the groups that its judged rows make."""
    sizes = stats.groupBy("pair", "_l").agg(F.count("*").alias("pair_rows"), F.count(F.when(judged, 1)).alias("n"))
    langs = sizes.groupBy("_l").agg(F.sum("n").alias("in_lang"), F.max((F.col("n") < MIN_GROUP) & (F.col("pair_rows") > 0)).alias("asked"))
    total = langs.agg(F.sum("in_lang").alias("in_all"), F.max(F.col("asked") & (F.col("in_lang") < MIN_GROUP)).alias("all_asked"))
    met = sizes.join(langs, "_l").crossJoin(F.broadcast(total))  # total is one row
    own = F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("s"), "pair"))
    lang = F.when(F.col("in_lang") >= MIN_GROUP, F.concat(F.lit("l"), "_l"))
    every = F.when(F.col("in_all") >= MIN_GROUP, F.lit("*"))
    return met.select("pair", "pair_rows", F.coalesce(own, lang, every).alias("grp"), F.array_compact(F.array(own, F.when(F.col("asked"), lang), F.when(F.col("all_asked"), every))).alias("makes"))


def outlier_distances(stats: DataFrame, stage: Stage, n_rows: int, limit: int = LIMIT) -> DataFrame:
    """stats with d2, the squared robust distance of each row within its group; null where there are too few rows for any."""
    lang = F.coalesce("lang", F.lit("\u0000"))
    pair = F.concat_ws("\u0001", lang, F.coalesce("source", F.lit("\u0000")))
    judged = F.col("n_words") >= MIN_WORDS
    rows = stats.select("*", pair.alias("pair"), lang.alias("_l"), *[c.alias(v) for c, v in zip(_vector(), VECTOR, strict=True)])
    groups = stage.write(_groups(judged, rows), "groups")
    rows = stage.write(attach(rows.drop("_l"), groups, "pair", "pair_rows", n_rows).drop("pair_rows"), "vectors")
    members = rows.filter(judged).select(F.explode("makes").alias("grp"), *VECTOR)
    sizes = stage.write(members.groupBy("grp").agg(F.count("*").alias("held")), "sizes")
    large = [r.grp for r in sizes.filter(F.col("held") > limit).select("grp").collect()]  # one for each limit rows at most
    models = (members.filter(~F.col("grp").isin(large)) if large else members).groupBy("grp").applyInPandas(_in_one_task, _MODEL)
    if large:
        models = models.unionByName(stats.sparkSession.createDataFrame(_by_passes(members, large), _MODEL))
    models = stage.write(models, "models")
    used = rows.groupBy("grp").agg(F.count("*").alias("held")).join(models, "grp")
    found = attach(rows, used, "grp", "held", n_rows).withColumn("d2", _distance() / F.col("wide"))
    rest = rows.filter("grp is null").withColumn("d2", F.lit(None).cast("double"))
    return found.select(*stats.columns, "d2").unionByName(rest.select(*stats.columns, "d2"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and d2 of every row."""
    spark = docs.sparkSession
    prepare(spark)
    stage = Stage(spark, "quality-rules")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    stats = stage.write(texts.mapInArrow(_counted, _STATS), "stats")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return outlier_distances(stats, stage, stats.count()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).alias("kept"), "d2",
    )
