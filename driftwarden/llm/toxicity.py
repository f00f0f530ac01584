"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and, in words that mix letters
with them, digits and signs to the letters they stand for.  The lexicon is learned from labelled rows:
whole words and word beginnings, weighted by how much likelier they are in toxic rows (a lower
confidence bound of the log odds), kept where chance does not explain them.  At a place the
heaviest entry counts, unless it is inside an exception phrase.  A text's total weight, the same
per length, and its heaviest entry make the score by a logistic function, which is fitted to
labelled rows that the lexicon has not seen.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, functions as F

from driftwarden.llm.frames import bounded_batches
from driftwarden.session import stage_table

FIT_ROWS = 12_000               # labelled rows the lexicon is learned from, at most (in expectation)
STEMS = range(4, 9)             # lengths of word beginnings
CUT = 0.7
# fixed values: letters of other scripts that look like Latin ones, and signs read as letters
LOOK_ALIKE = dict(zip("аеорсухіјѕԁԛԝһӏвкмнтгьαβεικνορτυχηω", "aeopcyxijsdqwhlbkmhtrbabeiknoptuxnw"))
READ_AS = dict(zip("0134578@$!|", "oieastbasil"))
EXCEPTIONS = ("trash can", "trash bin", "sore loser", "clown fish", "class clown")


def _fold_table() -> dict[int, str | None]:
    """Look-alikes, full-width forms, and characters that cannot be seen."""
    table = {ord(a): b for a, b in LOOK_ALIKE.items()}
    table.update({0xFF00 + c - 0x20: chr(c).lower() for c in range(0x21, 0x7F)})
    table.update({c: None for c in (0xAD, *range(0x200B, 0x2010), 0xFEFF)})
    return table


FOLD = _fold_table()
SIGNS = str.maketrans(READ_AS)
SIGN = re.compile("[0134578@$!|]")
WORD = re.compile(r"[^\W_]+")


def _read_signs(token: str) -> str:
    core = token.rstrip("!|")
    if SIGN.search(core) and sum(c.isalpha() for c in core) * 2 >= len(core):
        return core.translate(SIGNS) + token[len(core):]
    return token


def folded(text: str | None) -> str:
    if not isinstance(text, str):
        return ""
    text = text.lower().translate(FOLD) if not text.isascii() else text.lower()
    if SIGN.search(text):
        text = " ".join(map(_read_signs, text.split()))
    return text


def held_out(doc_id):
    """Rows a label may not be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _patterns(words: set[str]) -> set[str]:
    """Whole words end in a space; the others are beginnings."""
    out = {w + " " for w in words}
    for n in STEMS:
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text, toxic and a hash of about `fit_rows` labelled rows of `docs` at most, none of them held out.

    Several labels of one doc_id count as their largest; rows without id or label are passed over.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out("doc_id")))
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (rows.join(F.broadcast(known), "doc_id")
            .select("text", "toxic", F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(3)).alias("part")))


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """{pattern: weight} from labelled rows (text, toxic); empty without labels of both kinds."""
    def count(batches):
        for pdf in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                seen[int(toxic > 0)].update(_patterns(set(WORD.findall(folded(text)))) | {""})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"pattern": keys, "neg": [seen[0][k] for k in keys], "pos": [seen[1][k] for k in keys]})

    counts = stage_table(rows.select("text", "toxic").mapInPandas(count, "pattern string, neg long, pos long")
                         .groupBy("pattern").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
                         .filter("pos >= 3 or pattern = ''"), "patterns")
    totals = counts.filter("pattern = ''").first()
    if not totals or not totals.neg or not totals.pos:
        return {}
    neg_rows, pos_rows = totals.neg, totals.pos
    base = pos_rows / (pos_rows + neg_rows)
    patience = math.log(10 * max(1, counts.count()))
    kept: dict[str, tuple[int, float]] = {}
    for r in counts.filter(F.col("pos") * neg_rows > F.col("neg") * (3 * pos_rows)).collect():
        found = r.pos + r.neg
        surprise = r.pos * math.log(r.pos / (found * base))
        if r.neg:
            surprise += r.neg * math.log(r.neg / (found * (1 - base)))
        odds = math.log((r.pos + 0.5) / (r.neg + 0.5) * (neg_rows + 1) / (pos_rows + 1))
        weight = odds - math.sqrt(1 / (r.pos + 0.5) + 1 / (r.neg + 0.5))
        if r.pattern and weight > 0.7 and surprise >= patience:
            kept[r.pattern] = (r.pos, weight)
    # a beginning gives way to a continuation that is about as frequent, a continuation to a beginning that weighs as much
    longer: dict[str, list[str]] = {}
    for pattern in kept:
        for n in range(1, len(pattern)):
            longer.setdefault(pattern[:n], []).append(pattern)
    chosen = {p for p, (pos, _) in kept.items() if not any(kept[q][0] >= 0.8 * pos for q in longer.get(p, ()))}
    return {p: kept[p][1] for p in sorted(chosen)
            if not any(p[:n] in chosen and kept[p[:n]][1] >= kept[p][1] - 0.5 for n in range(1, len(p)))}


@functools.lru_cache(maxsize=2)
def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    """Values: (length, weight as a whole word, weight as a beginning, whether an exception phrase)."""
    values: dict[str, list] = {}
    for pattern, weight in entries:
        body = pattern.rstrip(" ")
        values.setdefault(body, [None, None, False])[0 if pattern != body else 1] = weight
    for phrase in exceptions:
        values.setdefault(folded(phrase), [None, None, False])[2] = True
    out = ahocorasick.Automaton()
    for body, value in values.items():
        out.add_word(body, (len(body), *value))
    out.make_automaton()
    return out


def features(text: str | None, entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> list[float]:
    """(log total weight, log weight per length, heaviest entry) of a text."""
    if not entries or not isinstance(text, str) or not text:
        return [0.0, 0.0, 0.0]
    text = folded(text)
    places, spared = {}, []
    for last, (size, whole, stem, exempt) in _automaton(entries, exceptions).iter(text):
        first, stop = last + 1 - size, last + 1
        if first and text[first - 1].isalnum():
            continue
        ends = stop == len(text) or not text[stop].isalnum()
        if exempt and ends:
            spared.append((first, stop))
        weight = max((w for w in (whole if ends else None, stem) if w is not None), default=0.0)
        if weight > places.get(first, 0.0):
            places[first] = weight
    weights = [w for first, w in places.items() if not any(a <= first < b for a, b in spared)]
    total, words = sum(weights), text.count(" ") + text.count("\n") + 1
    return [math.log1p(total), math.log1p(100 * total / (words + 20)), max(weights, default=0.0)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic fit, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


@dataclass(frozen=True)
class Model:
    """Lexicon entries, exception phrases and the logistic function's coefficients (none: every score is 0)."""
    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    beta: tuple[float, ...]

    def score(self, text: str | None) -> float:
        if not self.beta:
            return 0.0
        z = sum(b * v for b, v in zip(self.beta, [*features(text, self.entries, self.exceptions), 1.0]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions=EXCEPTIONS) -> Model:
    """Two thirds of the sample teach the lexicon, the rest the logistic function."""
    rows = sample_rows(bounded_batches(docs), labels, fit_rows)
    entries, exceptions = tuple(learn_lexicon(rows.filter("part > 0")).items()), tuple(exceptions)

    def rate(batches):
        for pdf in batches:
            found = [features(t, entries, exceptions) for t in pdf["text"]]
            yield pd.DataFrame({"part": pdf["part"], "toxic": pdf["toxic"], "x": found})

    rated = rows.mapInPandas(rate, "part long, toxic int, x array<double>").collect()      # at most fit_rows short rows
    unseen = [r for r in rated if r.part == 0]
    if min(sum(r.toxic > 0 for r in unseen), sum(r.toxic <= 0 for r in unseen)) < 5:
        unseen = rated
    y = np.array([float(r.toxic > 0) for r in unseen])
    if not entries or not 0 < y.sum() < len(y):
        return Model(entries, exceptions, ())
    return Model(entries, exceptions, tuple(_logistic(np.array([r.x for r in unseen]), y).tolist()))


def _scorer(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return score(F.col("text").cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions=EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of `docs` (doc_id, text; other columns are not looked at).

    A null or empty text scores as one without entries; a null doc_id is not held out; repeated rows each
    get their score; an empty table gives no rows, and without labels of both kinds every score is 0.
    """
    model = fit(docs, labels, fit_rows, exceptions)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _scorer(docs, model).alias("score"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions=EXCEPTIONS) -> DataFrame:
    """`docs` (all columns) without the rows that score `CUT` or more."""
    return docs.filter(_scorer(docs, fit(docs, labels, fit_rows, exceptions)) < CUT)
