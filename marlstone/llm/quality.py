"""Text quality by a linear-chain conditional random field over lines.

Every line that is not blank is labelled good or bad: its potentials come from its own features and those of its neighbouring lines, and the label of
a line depends on that of the line before. Forward-backward gives each line's probability of being good, exactly; their mean, weighted by the lines'
lengths, is what a document is judged by, through a logistic curve that is fitted with the rest.

Labels are known for documents only. The chain is first fitted as if all lines had their document's label; then lines of bad documents that it finds rather
good are taken for good (the worst one stays bad) and it is fitted again. Line features are thresholds on shares and counts, computed by numpy for many
texts at once. Scoring moves no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, release, slices, written
from .shingles import code_points, word_spans

LOWER, UPPER, DIGIT, SPACE, POINT, SYMBOL = range(6)
SHARES = (0.02, 0.1, 0.25, 0.5)
#: What a line is measured by, and the thresholds whose passing is a feature each.
MEASURES = {
    "upper": SHARES, "digit": SHARES, "point": SHARES, "symbol": SHARES, "same_as_last": SHARES, "same_as_before": SHARES,
    "word_length": (2.0, 4.0, 6.0, 9.0, 14.0), "words": (0.5, 2.5, 6.5, 20.5, 80.5), "line_again": (0.5,), "few_words_in_many": (0.3, 0.6),
}
FEATURES = sum(map(len, MEASURES.values()))
#: Lines of a training sequence, and sequences of one document, evenly spread, that the fit reads.
PIECE, PIECES = 64, 8
CLIP = 30.0


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For each code point what it counts as."""
    out = np.full(0x110000, SYMBOL, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = UPPER if c.isupper() else LOWER
        elif c.isdigit():
            out[cp] = DIGIT
        elif c.isspace():
            out[cp] = SPACE
        elif c in ".,;:?!'\"()-’“”…¿¡–—":
            out[cp] = POINT
    return out


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts that are not blank, in order: features (uint8, a row for each line), length in code points, and the place of their text."""
    texts = [t or "" for t in texts]
    s = code_points("\n".join(texts))
    if not len(s):
        return np.zeros((0, FEATURES), np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(s == 10) + 1])
    size = np.diff(np.append(begin, len(s) + 1)) - 1
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(text_ends, begin, "right")
    kind = kinds()[s]
    line = np.repeat(np.arange(len(begin)), size + 1)[: len(s)]
    n = np.bincount(line * 6 + kind, minlength=len(begin) * 6).reshape(-1, 6).astype(np.float64)
    n[:-1, SPACE] -= 1  # the line feed
    start, end, words = word_spans(s)
    home = line[start]
    first = np.ones(len(words), bool)
    first[1:] = home[1:] != home[:-1]
    count = lambda mask: np.bincount(home[mask], minlength=len(begin)).astype(np.float64)
    per = np.bincount(home, minlength=len(begin)).astype(np.float64)

    def again(back: int) -> np.ndarray:
        same = np.zeros(len(words), bool)
        same[back:] = (words[back:] == words[:-back]) & (home[back:] == home[:-back])
        return same

    last, before = again(1), again(2) | again(3) | again(4)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words, dtype=np.uint64)])
    ends = np.cumsum(per.astype(np.int64))
    whole = sums[ends] - sums[ends - per.astype(np.int64)]
    keep = n[:, [LOWER, UPPER, DIGIT, POINT, SYMBOL]].sum(axis=1) > 0
    n, per, whole, of_kept, size_kept = n[keep], per[keep], whole[keep], of[keep], size[keep]
    # the words of a line as those of one of the two lines before, in the same text
    line_again = np.zeros(len(per), bool)
    for back in (1, 2):
        line_again[back:] |= (whole[back:] == whole[:-back]) & (of_kept[back:] == of_kept[:-back]) & (per[back:] > 0)
    letters, shown = n[:, LOWER] + n[:, UPPER], n.sum(axis=1) - n[:, SPACE]
    most = np.maximum(per, 1)
    rare = np.where(per >= 10, (count(last) + count(before & ~last))[keep] / most, 0.0)
    measured = {
        "upper": np.where(letters > 8, n[:, UPPER] / np.maximum(letters, 1), 0.0), "digit": n[:, DIGIT] / shown, "point": n[:, POINT] / shown, "symbol": n[:, SYMBOL] / shown,
        "same_as_last": count(last)[keep] / most, "same_as_before": count(before)[keep] / most, "word_length": np.bincount(home, end - start, len(begin))[keep] / most,
        "words": per, "line_again": line_again.astype(float), "few_words_in_many": rare,
    }
    columns = [(measured[name] > t) for name, thresholds in MEASURES.items() for t in thresholds]
    return np.stack(columns, axis=1).astype(np.uint8), size_kept.astype(np.int64), of_kept.astype(np.int64)


def node_scores(features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """What a line's features and those of the lines before and after it say for good, of one sequence. weights: a row for each of the three."""
    parts = features.astype(np.float64) @ weights.T
    out = parts[:, 0] + bias
    out[1:] += parts[:-1, 1]
    out[:-1] += parts[1:, 2]
    return out


def marginals(scores: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Each line's log-odds of being good by forward-backward. turns[a, b]: what label b after label a counts for."""
    (t00, t01), (t10, t11) = turns.tolist()
    n = len(scores)
    s = scores.tolist()
    exp, log = math.exp, math.log
    forward, passed = [0.0] * n, 0.0
    for i in range(n):
        a = forward[i] = s[i] + passed
        e = exp(max(-CLIP, min(CLIP, a)))
        passed = log((e * exp(t11) + exp(t01)) / (e * exp(t10) + exp(t00)))
    passed = 0.0
    for i in range(n - 1, -1, -1):
        forward[i] += passed
        e = exp(max(-CLIP, min(CLIP, s[i] + passed)))
        passed = log((e * exp(t11) + exp(t10)) / (e * exp(t01) + exp(t00)))
    return np.array(forward)


def fit_chain(features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights (a row each for the line, the line before and the line after), bias and turns of the likeliest chain with a ridge, by gradient steps of adapted size.

    features, labels: of all lines of all sequences, one after another; sizes: lines of each sequence.
    """
    n, width, longest = len(sizes), features.shape[1], int(sizes.max())
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(features)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x = np.zeros((len(features), 3 * width + 1))
    x[:, :width] = features
    inner = place > 0
    x[inner, width : 2 * width] = features[np.flatnonzero(inner) - 1]
    inner = place < sizes[row] - 1
    x[inner, 2 * width : 3 * width] = features[np.flatnonzero(inner) + 1]
    x[:, -1] = 1
    inside = np.zeros((n, longest), bool)
    inside[row, place] = True
    y = np.zeros((n, longest), np.int64)
    y[row, place] = labels
    both = inside[:, 1:]
    seen = np.array([[(both & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        turns = theta[-4:].reshape(2, 2)
        node = np.zeros((n, longest, 2))
        node[row, place, 1] = x @ theta[:-4]
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = node[:, 0]
        for t in range(1, longest):
            alpha[:, t] = node[:, t] + np.logaddexp(alpha[:, t - 1, :1] + turns[0], alpha[:, t - 1, 1:] + turns[1])
        for t in range(longest - 2, -1, -1):
            after = node[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(both[:, t, None], np.logaddexp(after[:, :1] + turns[:, 0], after[:, 1:] + turns[:, 1]), 0.0)
        odds = (alpha + beta)[..., 1] - (alpha + beta)[..., 0]
        good = 1 / (1 + np.exp(-np.clip(odds, -CLIP, CLIP)))
        whole = np.logaddexp(*np.moveaxis(alpha + beta, 2, 0))[:, :-1]
        expected = np.empty((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = alpha[:, :-1, a] + turns[a, b] + node[:, 1:, b] + beta[:, 1:, b] - whole
                expected[a, b] = np.exp(np.minimum(joint, 0.0))[both].sum()
        slope = np.concatenate([x.T @ (labels - good[row, place]), (seen - expected).ravel()]) - ridge * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.15 * (1 - 0.9 * step / rounds) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return theta[: 3 * width].reshape(3, width), float(theta[3 * width]), theta[-4:].reshape(2, 2)


def weighted_good(model: dict, features: np.ndarray, length: np.ndarray) -> float:
    """The length-weighted mean of the lines' probabilities of being good, of one text with lines."""
    good = 1 / (1 + np.exp(-np.clip(marginals(node_scores(features, model["weights"], model["bias"]), model["turns"]), -CLIP, CLIP)))
    return float((good * length).sum() / length.sum())


def _features_of(rows: DataFrame) -> DataFrame:
    """y, lines, features, length (as bytes) of rows(t, y)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for part in slices(batch.column(0)):
                features, length, of = line_features(part.to_pylist())
                cut = np.searchsorted(of, np.arange(len(part) + 1))
                columns = [[a[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)] for a in (features, length.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, len(part)), pa.array(np.diff(cut).astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], names=["y", "lines", "features", "length"]
                )
                lo += len(part)
        release()

    return rows.select("t", "y").mapInArrow(gather, "y int, lines int, features binary, length binary")


def _pieces(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, sizes, labels and documents (by number) of training sequences: of each document PIECES pieces of PIECE lines, evenly spread, or all of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, lines, features = [], [], []
            for y, n, f in zip(*(batch.column(c).to_pylist() for c in ("y", "lines", "features")), strict=True):
                pieces = max(1, -(-n // PIECE))
                chosen = range(pieces) if pieces <= PIECES else [i * pieces // PIECES for i in range(PIECES)]
                for i in chosen if n else ():
                    ys.append(y)
                    lines.append(min(n, (i + 1) * PIECE) - i * PIECE)
                    features.append(f[i * PIECE * FEATURES : (i * PIECE + lines[-1]) * FEATURES])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(lines, pa.int32()), pa.array(features, pa.binary())], names=["y", "lines", "features"])

    # at most PIECES * PIECE rows of FEATURES bytes for each document of the sample
    got = sample.select("y", "lines", "features").mapInArrow(cut, "y int, lines int, features binary").orderBy("y", "lines", "features").toArrow()
    flat = np.frombuffer(b"".join(got["features"].to_pylist()), np.uint8).reshape(-1, FEATURES)
    return flat, got["lines"].to_numpy().astype(np.int64), got["y"].to_numpy().astype(np.int64)


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows_per_label: int = 2000, refits: int = 2) -> dict:
    """The chain and the curve from docs(key, text) and labels(key, label); label 1 is good.

    About rows_per_label documents of each label are used, chosen by a hash of the key, and of each at most PIECES times PIECE lines for the chain: the documented bounds of
    the fit. Which lines are read does not depend on the table's size. Rows with a null key or label do not count; a null text counts as empty. Labels of one kind only,
    or of none, give a model that answers the label there is (0 if there is none).
    """
    rows = labels.select(F.col(key).alias("k"), (F.col(label) != 0).cast("int").alias("y")).where("k is not null and y is not null")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows
    one = {"weights": np.zeros((3, FEATURES)), "bias": 0.0, "turns": np.zeros((2, 2)), "curve": (CLIP if 1 in sizes else -CLIP, 0.0), "base": CLIP if 1 in sizes else -CLIP}
    if len(sizes) < 2:
        return one
    share = {y: min(1.0, rows_per_label / n) for y, n in sizes.items()}
    chosen = rows.where(F.expr(f"pmod(xxhash64(k), 1000000) * 1e-6 < if(y = 1, {share[1]}, {share[0]})"))
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sample = written(_features_of(texts.join(F.broadcast(chosen), "k")), "quality-sample")  # about 2 * rows_per_label ids
    base = math.log(sizes[1] / sizes[0])
    features, lines, ys = _pieces(sample)
    if len(set(ys.tolist())) < 2:
        return one | {"curve": (base, 0.0), "base": base}
    targets = np.repeat(ys, lines)
    ends = np.cumsum(lines)
    model = dict(zip(("weights", "bias", "turns"), fit_chain(features, lines, targets), strict=True))
    for _ in range(refits):
        for lo, hi, y in zip(ends - lines, ends, ys, strict=True):
            if y == 0:
                odds = marginals(node_scores(features[lo:hi], model["weights"], model["bias"]), model["turns"])
                targets[lo:hi] = odds > 0
                targets[lo + int(np.argmin(odds))] = 0
        model = dict(zip(("weights", "bias", "turns"), fit_chain(features, lines, targets), strict=True))
    fitted = dict(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for f, n in zip(batch.column("features").to_pylist(), batch.column("length").to_pylist(), strict=True):
                found.append(weighted_good(fitted, np.frombuffer(f, np.uint8).reshape(-1, FEATURES), np.frombuffer(n, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.float64())], names=["y", "good"])

    judged = sample.where("lines > 0").select("y", "features", "length").mapInArrow(judge, "y int, good double").orderBy("y", "good").toArrow()  # two numbers a row of the sample
    return model | {"curve": fit_curve(judged["good"].to_numpy(), judged["y"].to_numpy(), base), "base": base}


def logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def fit_curve(good: np.ndarray, y: np.ndarray, base: float, ridge: float = 0.05, rounds: int = 30) -> tuple[float, float]:
    """Intercept and slope (not below 0) from the mean's log-odds to the label's, by Newton's method; the intercept fits the share of the labels among all rows (log-odds base)."""
    x = np.stack([np.ones(len(good)), logit(good)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -CLIP, CLIP)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    ones = max(1, int((y == 1).sum()))
    zeros = max(1, int((y == 0).sum()))
    return float(w[0] + base - math.log(ones / zeros)), float(max(0.0, w[1]))


def quality(model: dict, text: Column, least: float = 0.3) -> Column:
    """struct(score double, predicted int): the probability of label 1, and whether it is least or more. Null, empty and blank texts get the share of label 1 among the labels. Texts are read whole."""
    intercept, slope = model["curve"]

    @F.arrow_udf("score double, predicted int")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[float] = []
            for part in slices(texts):
                features, length, of = line_features(part.to_pylist())
                cut = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
                for i, j in zip(cut, cut[1:], strict=False):
                    z = intercept + slope * logit(weighted_good(model, features[i:j], length[i:j])) if j > i else model["base"]
                    out.append(1 / (1 + math.exp(-max(-CLIP, min(CLIP, z)))))
            yield pa.StructArray.from_arrays([pa.array(out, pa.float64()), pa.array([int(x >= least) for x in out], pa.int32())], names=["score", "predicted"])
        release()

    return score(text)


def line_quality(model: dict, text: Column) -> Column:
    """array<struct(line int, length int, good double)>: each line's probability of being good; line numbers count from 0 and skip no blank line, which itself is left out. Null for a null text."""

    @F.arrow_udf("array<struct<line:int,length:int,good:double>>")
    def lines(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out: list[list | None] = []
            for t in texts.to_pylist():
                features, length, _ = line_features([t])
                odds = marginals(node_scores(features, model["weights"], model["bias"]), model["turns"]) if len(length) else []
                at = [i for i, x in enumerate((t or "").split("\n")) if x.strip()]
                out.append(None if t is None else [{"line": i, "length": int(n), "good": 1 / (1 + math.exp(-max(-CLIP, min(CLIP, z))))} for i, n, z in zip(at, length, odds, strict=True)])
            yield pa.array(out, pa.list_(pa.struct([("line", pa.int32()), ("length", pa.int32()), ("good", pa.float64())])))
        release()

    return lines(text)


def score_quality(docs: DataFrame, model: dict, text: str = "text", least: float = 0.3) -> DataFrame:
    """docs with quality_score and quality_predicted; columns of those names that docs already has are replaced, all others stay as they are.

    Null, empty and blank texts get the share of label 1 among the labels; texts of any length are read whole; repeated rows get the same score. An empty table gives an empty table.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("quality_score", "quality_predicted")]
    (found,) = free_names(docs, "found")
    scored = docs.select(*kept, quality(model, F.col(text), least).alias(found))
    return scored.select(*kept, F.col(f"{found}.score").alias("quality_score"), F.col(f"{found}.predicted").alias("quality_predicted"))
