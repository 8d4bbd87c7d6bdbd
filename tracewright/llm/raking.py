"""Mixing sources to target weights by iterative proportional fitting.

The token weights of the cells (source, language, topic) are scaled to one marginal after the
other until all three fit. There may be any number of sources, but few languages and topics:
one row per source holds its cells, so the step along the sources needs no shuffle, and a
sweep is one job that sums the scaled weights per (language, topic). Only these sums, whose number
is bounded and checked, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import SPACE, WORD, few_files, text_or_empty, unit_hash
from tracewright.plans.tables import materialize

NARROW_CELLS = 100_000
DIMS = ["source", "lang", "topic"]
INNER, LARGE = 60, 1e12          # steps along a source with bounded cells; a factor that no cell exceeds before the bound


@dataclass(frozen=True)
class Mix:
    """Target shares of a marginal are its current shares to the given power (1 leaves it as it is), or
    those given in ``shares`` ({"lang": {"=en": 0.5, ...}}; values are written with a leading "=", null is
    "null"). ``tolerance`` is the largest error of a marginal at the end, as a share of all weights. No factor
    exceeds ``trim``, so that a rare cell does not make all others rare: the fit works inside this bound, and other cells take what
    a bounded one cannot."""
    source: float = 0.8
    lang: float = 0.9
    topic: float = 0.95
    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    tolerance: float = 1e-4
    sweeps: int = 50
    trim: float = 10.0
    seed: int = 7


def word_count(name: str = "text") -> Column:
    """Number of words, without an array of them: each word becomes one sign, then blanks go."""
    signs = F.regexp_replace(text_or_empty(name), WORD, "x")
    return F.length(F.regexp_replace(signs, f"[{SPACE}]+", "")).cast("long")


def topic_of(text: Column, n_words: Column) -> Column:
    """A plain topic for tables without one: the form of the text, from its signs and length."""
    size = F.greatest(F.length(text), F.lit(1))

    def share(others: str) -> Column:
        return F.length(F.regexp_replace(text, others, "")) / size

    return (F.when(share(r"[^|]+") > 0.03, "table").when(share("[^#*$%&]+") > 0.05, "markup")
            .when(share("[^A-Z]+") > 0.4, "capitals").when(n_words < 60, "short")
            .when(n_words >= 1000, "long").otherwise("prose"))


def value_key(name: str) -> Column:
    """A value as text with a leading sign, so that null ("null") is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def goals(weights: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """Target shares of the values that occur; given shares of others are shared out."""
    raw = {v: (given.get(v, 0.0) if given is not None else w ** power) for v, w in weights.items()}
    total = sum(raw.values()) or 1.0
    return {v: x / total for v, x in raw.items()}


@dataclass(frozen=True)
class Fit:
    """``factors``: source, lang, topic (as keys) and factor (fitted over current weight) of every cell; the ``largest`` of them; and by
    marginal the largest difference to a target that remains, as a share of all weights."""
    factors: DataFrame
    largest: float
    errors: dict[str, float]


def cell_factors(cells: DataFrame, rule: Mix = Mix()) -> Fit:
    """Bounded raking. ``cells``: source, lang, topic, weight > 0, one row per cell, a stored table.

    Every step scales a marginal by what the bounded factors lack, until all marginals fit within the tolerance, or for ``sweeps`` sweeps
    if the targets contradict each other or the bound; ``Fit.errors`` tells. A value with target 0 gets factor 0.
    """
    sums = cells.groupBy("lang", "topic").agg(F.sum("weight").alias("weight")).limit(NARROW_CELLS + 1).collect()
    if len(sums) > NARROW_CELLS:
        raise ValueError(f"more than {NARROW_CELLS} pairs of language and topic")
    sums.sort(key=lambda r: (r["lang"], r["topic"]))
    width = len(sums)
    place = {(r["lang"], r["topic"]): j for j, r in enumerate(sums)}
    weight = np.array([r["weight"] for r in sums], float)
    total = float(weight.sum())
    axes = []                                   # per narrow marginal: index of every pair, target weights
    for name, power in (("lang", rule.lang), ("topic", rule.topic)):
        of = [r[name] for r in sums]
        names = sorted(set(of))
        now = {v: float(weight[[x == v for x in of]].sum()) for v in names}
        target = goals(now, power, rule.shares.get(name))
        axes.append((np.array([names.index(x) for x in of], int), np.array([target[v] * total for v in names])))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source": b["source"], "total": [sum(c["weight"] for c in x) for x in b["cells"]],
                                "pair": [[place[c["lang"], c["topic"]] for c in x] for x in b["cells"]],
                                "weight": [[c["weight"] for c in x] for x in b["cells"]]})

    wide = materialize(cells.groupBy("source").agg(F.collect_list(F.struct("lang", "topic", "weight")).alias("cells"))
                       .mapInPandas(rows, "source string, total double, pair array<int>, weight array<double>"), "sources")
    given = rule.shares.get("source")
    if given is not None:
        share = F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col("source"))
        raw = F.coalesce(share, F.lit(0.0))
    else:
        raw = F.pow("total", F.lit(rule.source))
    mass = wide.agg(F.sum(raw)).first()[0] or 1.0
    wide = wide.withColumn("goal", raw * F.lit(total / mass))

    def scaled(batch: pd.DataFrame, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and pair of every cell of a batch, its weight, and its factor after the step along the sources."""
        size = batch["pair"].map(len).to_numpy()
        row = np.repeat(np.arange(len(batch)), size)
        pair = np.concatenate([*batch["pair"], np.zeros(0, int)]).astype(int)
        own = np.concatenate([*batch["weight"], np.zeros(0)])
        goal, ratio = batch["goal"].to_numpy(float), np.ones(len(batch))
        for _ in range(INNER):                  # once is enough where no factor is at the bound
            part = np.bincount(row, own * np.minimum(ratio[row] * factor[pair], rule.trim), len(batch))
            step = np.divide(goal, part, out=np.zeros(len(batch)), where=part > 0)
            ratio = np.minimum(ratio * step, LARGE)
            if np.all(np.abs(step - 1) < 1e-12):
                break
        return row, pair, own, np.minimum(ratio[row] * factor[pair], rule.trim)

    def sweep(factor: np.ndarray):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, held, lack = np.zeros(width), np.zeros(width), 0.0
            for batch in batches:
                row, pair, own, f = scaled(batch, factor)
                out += np.bincount(pair, own * f, width)
                held += np.bincount(pair, own * f * (f >= rule.trim), width)
                lack = max(lack, float(np.abs(np.bincount(row, own * f, len(batch)) - batch["goal"].to_numpy(float)).max(initial=0.0)))
            yield pd.DataFrame({"pair": np.arange(width), "weight": out, "held": held, "lack": lack})
        return work

    factor, errors = np.ones(width), {d: 0.0 for d in DIMS}
    for turn in range(rule.sweeps + 1 if width else 0):                                       # the last turn only measures
        found = (wide.select("goal", "pair", "weight").mapInPandas(sweep(factor), "pair int, weight double, held double, lack double")
                 .groupBy("pair").agg(F.sum("weight").alias("weight"), F.sum("held").alias("held"), F.max("lack").alias("lack")).collect())   # one row per pair
        now, held = np.zeros(width), np.zeros(width)
        for r in found:
            now[r["pair"]], held[r["pair"]] = r["weight"], r["held"]
        errors["source"] = max(r["lack"] for r in found) / total
        for name, (index, target) in zip(("lang", "topic"), axes):
            errors[name] = float(np.abs(np.bincount(index, now, len(target)) - target).max() / total)
        if max(errors.values()) < rule.tolerance or turn == rule.sweeps:
            break
        for index, target in axes:
            have, fixed = np.bincount(index, now, len(target)), np.bincount(index, held, len(target))
            fixed = np.where((target > have) & (have > fixed), fixed, 0.0)         # cells at the bound cannot grow: the others do
            ratio = np.divide(target - fixed, have - fixed, out=np.zeros(len(target)), where=have > fixed)
            factor = np.minimum(factor * ratio[index], LARGE)
            now = np.where(fixed[index] > 0, held + (now - held) * ratio[index], now * ratio[index])

    names = [(r["lang"], r["topic"]) for r in sums]

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            row, pair, _, f = scaled(batch, factor)
            yield pd.DataFrame({"source": batch["source"].to_numpy()[row], "lang": [names[p][0] for p in pair],
                                "topic": [names[p][1] for p in pair], "factor": f})

    table = materialize(wide.mapInPandas(final, "source string, lang string, topic string, factor double"), "factors")
    return Fit(table, float(table.agg(F.max("factor")).first()[0] or 1.0), errors)


def mix(docs: DataFrame, rule: Mix = Mix()) -> DataFrame:
    """``docs`` (doc_id, source, lang, topic, n_tokens, ...) with factor, probability, selected, and error_source, error_lang and error_topic:
    how far the expected share of a value is from its target at most.

    The probability is the factor of the cell over the largest factor, so the expected weights of the sample
    have the target shares, up to these errors, and no document is taken twice. Selection depends on doc_id and the seed
    only, so repeated rows go together. A document without tokens is never selected. Null ids share one draw, unless a
    column draw_key tells the rows apart (see ``draw_key``); it is dropped.
    """
    keys = [value_key(d).alias(d) for d in DIMS]
    cells = materialize(docs.groupBy(*keys).agg(F.sum("n_tokens").cast("double").alias("weight"))
                        .filter(F.col("weight") > 0), "cells")
    fit = cell_factors(cells, rule)
    on = None
    for d in DIMS:
        same = value_key(d) == F.col(f"_{d}")
        on = same if on is None else on & same
    out = docs.join(fit.factors.select(*[F.col(d).alias(f"_{d}") for d in DIMS], "factor"), on, "left")
    out = out.drop(*[f"_{d}" for d in DIMS]).withColumn("factor", F.coalesce("factor", F.lit(0.0)))
    p = F.when(F.col("n_tokens") > 0, F.col("factor") / F.lit(fit.largest)).otherwise(0.0)
    own = "draw_key" if "draw_key" in docs.columns else "doc_id"
    draw = unit_hash(F.coalesce(F.col(own).cast("long"), F.lit(-1)), rule.seed)
    out = out.withColumn("probability", p).withColumn("selected", draw < F.col("probability")).drop("draw_key")
    return out.withColumns({f"error_{d}": F.lit(fit.errors[d]) for d in DIMS})


def draw_key(doc_id: str, text: str) -> Column:
    """What a document's draw follows from: its id, without one its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text_or_empty(text)))


def documents_with_topic(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words), draw_key. Null texts have no tokens."""
    n = docs.select("doc_id", "source", "lang", text_or_empty().alias("text"), word_count().alias("n_tokens"), draw_key("doc_id", "text").alias("draw_key"))
    return n.select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens", "draw_key")


def mixture(docs: DataFrame, rule: Mix = Mix()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, selected and the errors (see ``mix``) of every document. An empty
    table gives an empty result; other columns are ignored."""
    return few_files(mix(materialize(few_files(documents_with_topic(docs)), "weights"), rule))


def keep_sample(docs: DataFrame, rule: Mix = Mix()) -> DataFrame:
    """The selected documents with their columns. A row's fate follows from its id (its text without one) and its own cell."""
    rows = docs.select(F.struct("*").alias("_row"))
    keyed = rows.select("_row", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "source", "lang")],
                        word_count("_row.text").alias("n_tokens"),
                        draw_key("_row.doc_id", "_row.text").alias("draw_key"))
    keyed = keyed.withColumn("topic", topic_of(text_or_empty("_row.text"), F.col("n_tokens")))
    return mix(keyed, rule).filter("selected").select("_row.*")
