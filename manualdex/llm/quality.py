"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

Statistics of a text (lengths, shares of kinds of characters, shares of distinct words and lines) are
column expressions over the whole text. Shallow boosted trees are grown on the statistics of a bounded
sample of labelled documents; every path from a root to a node is a rule, a conjunction of comparisons.
Lasso logistic regression weighs the rules, and those it keeps become one column expression, so scoring is
a plain projection in the scan.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are learned from, about: the bound of the sample.
SAMPLE = 20_000
TREES = 24
DEPTH = 3
#: Cuts tried for each statistic.
CUTS = 48
#: Fewest sampled documents in a node.
LEAST = 20
#: Penalties tried, as shares of the one that leaves no rule; the strongest close to the best is taken.
PENALTIES = (0.3, 0.1, 0.03, 0.01, 0.003)
STEPS = 400

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\x0c\r"


def _count(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text, null counting as empty; each is 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    plain = F.translate(text, _SPACES[1:], " " * 5)
    words = F.array_remove(F.split(plain, " "), "")
    lines = F.array_remove(F.split(text, "\n"), "")
    n_words = F.greatest(F.size(words), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": (F.length(text) - _count(text, _SPACES)) / n_words,
        "upper": _count(text, _LETTERS) / chars,
        "digits": _count(text, "0123456789") / chars,
        "ends": _count(text, ".?,;:") / chars,
        "stress": _count(text, "!") / chars,
        "bars": _count(text, "|<>{}[]=/\\_~^") / chars,
        "signs": _count(text, "#$%&*@+") / chars,
        "white": _count(text, _SPACES) / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": F.log1p(F.size(words) / n_lines),
    }


#: One comparison: the statistic's place, the cut, and whether its value is above the cut.
Term = tuple[int, float, bool]


@dataclass
class Rules:
    """Weighted rules: the log-odds are ``bias`` + the weights of the rules that hold."""

    names: list[str]
    bias: float
    rules: list[tuple[tuple[Term, ...], float]]

    def to_json(self) -> str:
        return json.dumps([self.names, self.bias, self.rules])

    @staticmethod
    def from_json(text: str) -> Rules:
        names, bias, rules = json.loads(text)
        return Rules(names, bias, [(tuple((at, cut, above) for at, cut, above in terms), w) for terms, w in rules])

    def score(self, statistic: dict[str, Column]) -> Column:
        """The probability as a column over columns of the statistics."""
        odds = F.lit(self.bias)
        for terms, weight in self.rules:
            holds = F.lit(True)
            for at, cut, above in terms:
                value = statistic[self.names[at]]
                holds = holds & (value > cut if above else value <= cut)
            odds = odds + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _holds(x: np.ndarray, terms: tuple[Term, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, cut, above in terms:
        out &= x[:, at] > cut if above else x[:, at] <= cut
    return out


def _grow(bins, cuts, rows, residual, terms, depth, found, value) -> None:
    """Splits ``rows`` where the squared error of ``residual`` falls most; notes paths and node values."""
    value[rows] = residual[rows].mean()
    if terms:
        found.add(tuple(sorted(set(terms))))
    if depth == 0 or len(rows) < 2 * LEAST:
        return
    best = (1e-9, None)
    total, r = residual[rows].sum(), residual[rows]
    for at in range(bins.shape[1]):
        own = bins[rows, at]
        n = np.cumsum(np.bincount(own, minlength=len(cuts[at]) + 1))[:-1]
        s = np.cumsum(np.bincount(own, weights=r, minlength=len(cuts[at]) + 1))[:-1]
        fits = (n >= LEAST) & (len(rows) - n >= LEAST)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, s**2 / n + (total - s) ** 2 / (len(rows) - n), -np.inf)
        if len(gain) and gain.max() - total**2 / len(rows) > best[0]:
            best = (gain.max() - total**2 / len(rows), (at, int(gain.argmax())))
    if best[1] is None:
        return
    at, b = best[1]
    for above in (False, True):
        inside = rows[(bins[rows, at] > b) == above]
        term = (at, float(cuts[at][b]), above)
        _grow(bins, cuts, inside, residual, (*terms, term), depth - 1, found, value)


def extract_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Term, ...]]:
    """The paths of ``TREES`` boosted trees of ``DEPTH`` levels."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    odds = np.full(len(y), _log_odds(y))
    found: set = set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        residual = y - p
        if np.abs(residual).max() < 1e-3:
            break
        value = np.zeros(len(y))
        _grow(bins, cuts, np.arange(len(y)), residual, (), DEPTH, found, value)
        odds = odds + 0.5 * value / max(float((p * (1 - p)).mean()), 1e-2)
    return sorted(found)


def _log_odds(y: np.ndarray) -> float:
    return math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray]):
    """Logistic regression with an absolute penalty on the weights, by accelerated proximal steps."""
    bias, w = start
    step = 4 / (float(np.linalg.eigvalsh(z.T @ z)[-1]) / len(y) + 1)
    at_b, at_w, t = bias, w.copy(), 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(at_b + z @ at_w.astype(z.dtype)))) - y
        new_b = at_b - step * error.mean()
        new_w = at_w - step * (error.astype(z.dtype) @ z) / len(y)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_t = (1 + math.sqrt(1 + 4 * t * t)) / 2
        at_b = new_b + (t - 1) / new_t * (new_b - bias)
        at_w = new_w + (t - 1) / new_t * (new_w - w)
        bias, w, t = new_b, new_w, new_t
    return bias, w


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rules:
    """Rules and weights from statistics and 0/1 labels; of labels of one kind, or none, only a bias."""
    if len(y) == 0:
        return Rules(names, 0.0, [])
    rules = extract_rules(x, y) if 0 < y.sum() < len(y) else []
    if not rules:
        return Rules(names, _log_odds(y), [])
    # Equal columns add nothing: keep the first rule of each. The driver holds one small float a cell.
    columns: dict[bytes, tuple[Term, ...]] = {}
    for rule in rules:
        columns.setdefault(np.packbits(_holds(x, rule)).tobytes(), rule)
    rules = list(columns.values())
    z = np.empty((len(y), len(rules)), np.float32)
    for i, rule in enumerate(rules):
        z[:, i] = _holds(x, rule)
    check = np.arange(len(y)) % 4 == 3
    most = np.abs(z.T @ (y - y.mean())).max() / len(y)

    def path(rows):
        state = (_log_odds(y[rows]), np.zeros(z.shape[1]))
        for share in PENALTIES:
            state = _lasso(z[rows], y[rows], share * most, state)
            yield state

    losses = []
    for bias, w in path(~check):
        p = np.clip(1 / (1 + np.exp(-(bias + z[check] @ w))), 1e-9, 1 - 1e-9)
        losses.append(float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()) if check.any() else 0.0)
    chosen = next(i for i, loss in enumerate(losses) if loss <= min(losses) * 1.02 + 1e-4)
    bias, w = [*path(np.ones(len(y), bool))][chosen]
    return Rules(names, float(bias), [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Rules:
    """Rules that tell label 1 from 0. ``labels`` has ``id_col`` and ``label``.

    At most about ``sample`` labelled ids are used, chosen by a hash of the id; rows without id or label
    are left out. The sampled labels are small and broadcast. The sample's statistics, about 100 bytes a row,
    meet in one task, which fits the rules there; only the rules reach the driver.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).filter(
        "_id IS NOT NULL AND _label IS NOT NULL"
    )
    n = usable.count()
    rate = min(1.0, sample / n) if n else 0.0
    chosen = usable.filter(F.xxhash64("_id") / F.lit(2.0**64) + 0.5 < rate)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_id", "_label", *[c.alias(k) for k, c in statistics(F.col("_text")).items()])
    )
    names = list(statistics(F.lit("")))

    def fitted(found: pa.Table) -> pa.Table:
        # Rows come in any order: sort them, so that the same rows give the same rules.
        keys = [*[found[k].to_numpy() for k in reversed(names)], found["_id"].to_numpy()]
        order = np.lexsort(keys)
        x = np.stack([found[k].to_numpy() for k in names], axis=1)[order]
        rules = fit(x, found["_label"].to_numpy().astype(float)[order], names)
        return pa.table({"rules": [rules.to_json()]})

    found = rows.groupBy().applyInArrow(fitted, "rules string").first()
    return Rules.from_json(found["rules"]) if found else Rules(names, 0.0, [])


def score(docs: DataFrame, rules: Rules, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``threshold`` on).

    Defined cases: a null text is empty, and an empty text has all statistics 0 and a score like any
    other. Columns of ``docs`` named ``score`` or ``predicted`` are replaced; other columns pass
    through. An empty table gives no rows.
    """
    kept = [F.col(c) for c in docs.columns if c not in ("score", "predicted")]
    stats = {f"_stat_{k}": v for k, v in statistics(F.col(text_col)).items()}
    # Plain columns would be put back into every rule that reads them, in a filter on the prediction too, and
    # make a plan of many times the size; what a generator gives is worked out once and only referred to.
    worked_out = docs.select(*kept, *[v.alias(k) for k, v in stats.items()])
    scored = worked_out.select(*kept, F.stack(F.lit(1), *stats).alias(*stats)).withColumn(
        "score", rules.score({k: F.col(f"_stat_{k}") for k in rules.names})
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(*stats)
