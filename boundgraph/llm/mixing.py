"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier learned from a labelled table reads a document's text, its
language and its length, and predicts a posterior over domains.  The words'
evidence is weighed by a factor that is chosen on held-out labelled rows, so words that tell
nothing do not pass for certainty.  Labelled documents belong to their own domain.
Documents of the same posterior, in steps of ``1 / GRAIN`` at most, form a *cell*, and
cells are summed before anything is shuffled.  Projected gradient least squares then
finds nonnegative rates: with a rate ``x`` for each document, the expected tokens of domain
``k`` are the sum of ``tokens * x * p_k``, and these totals are to match the targets.  In the
metric in which a document weighs as many tokens as it has, the gradient is the same for
all documents of a cell, and its Lipschitz constant is 1 (the posteriors sum to 1), so the
step needs no search.

A step is one aggregation of as many numbers as there are domains; momentum, which begins anew
where it overshoots, keeps them few.  The rates after a
number of steps follow from a posterior and the residuals of those steps, so every row has
its rate without a join; every ``KEPT_STEPS`` steps the cells are stored with their rates, so
the steps' plans stay small.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Domains that targets may have; each step gathers one number for each, and the classifier has BUCKETS times as many.
MOST_DOMAINS = 256
#: Hashed words of the classifier, and labelled documents that it is fitted on at most, drawn by hash of the id.
BUCKETS, FITTED = 4096, 20000
#: Labelled documents that a bucket is in at least, and deviations of its chi-square from chance, for it to count.
LEAST, SIGMAS = 5, 5.0
#: Additive smoothing of the classifier; factors that the evidence of a text's words may get.
SMOOTHING, FACTORS = 0.5, (0.0, 0.05, 0.1, 0.2, 0.4, 0.8, 1.6, 3.2, 6.4)
#: Steps that posteriors are rounded to, at least.
GRAIN = 64
#: Pull of the rates towards 1, steps at most, the relative error that ends them, and as many steps without any gain.
PULL, STEPS, CLOSE, STILL = 1e-6, 100, 1e-3, 8
#: Steps after which the cells are stored with their rates.
KEPT_STEPS = 16
METADATA = ("lang", "size")
_WORD = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words of a text, split at spaces and \\t..\\r; null and empty: none."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), _WORD), lambda w: w != "")


def n_tokens(text: str | Column) -> Column:
    """Words of a text, split at spaces and \\t..\\r; null and empty: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def features(docs: DataFrame, text_col: str) -> dict[str, Column]:
    """``lang``, ``size`` (the text's length in doublings) and ``buckets`` (its different lower-case words, hashed)."""
    text = F.col(text_col).cast("string")
    length = F.coalesce(F.length(text), F.lit(0))
    return {
        "lang": F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string"),
        "size": F.floor(F.log2(length + 1)).cast("string"),
        "buckets": F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))),
    }


def _numbers(values: list[float]) -> Column:
    """A constant array of any length; it is folded to one value when the plan is made."""
    return F.split(F.lit(",".join(f"{v:.5g}" for v in values)), ",").cast("array<double>")


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _times(a: Column, factor: float) -> Column:
    return F.transform(a, lambda x: x * factor)


@dataclass
class Classifier:
    """Logarithms: ``prior`` of each domain, ``meta[feature][value]`` and ``words`` of each bucket that tells something; ``factor`` weighs the words."""

    domains: list[str]
    prior: list[float]
    meta: dict[str, dict[str, list[float]]]
    words: dict[int, list[float]]
    factor: float

    def base(self, of: dict[str, Column]) -> Column:
        """What prior and metadata say; a value that no labelled row has says nothing."""
        out, none = _numbers(self.prior), _numbers([0.0] * len(self.domains))
        for f, known in self.meta.items():
            if known:
                values = sorted(known)
                place = F.array_position(F.array(*map(F.lit, values)), of[f])
                own = F.slice(_numbers([x for v in values for x in known[v]]), (place - 1) * len(self.domains) + 1, F.lit(len(self.domains)))
                out = _added(out, F.when(place > 0, own).otherwise(none))
        return out

    def evidence(self, of: dict[str, Column]) -> Column:
        """What the words that tell something say, over the square root of their number."""
        k, kept = len(self.domains), sorted(self.words)
        at = {b: i + 1 for i, b in enumerate(kept)}
        place = F.split(F.lit(",".join(str(at.get(b, 0)) for b in range(BUCKETS))), ",").cast("array<int>")
        table = _numbers([x for b in kept for x in self.words[b]])
        told = F.filter(F.transform(of["buckets"], lambda b: F.get(place, b)), lambda i: i > 0)
        summed = lambda t: F.aggregate(t, _numbers([0.0] * k), lambda s, i: _added(s, F.slice(table, (i - 1) * k + 1, F.lit(k))))
        return _once(told, lambda t: F.transform(summed(t), lambda x: x / F.sqrt(F.greatest(F.size(t), F.lit(1)))))

    def scores(self, of: dict[str, Column]) -> Column:
        """Logarithms of the posterior, but for a constant."""
        return _added(self.base(of), _times(self.evidence(of), self.factor)) if self.factor else self.base(of)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scaled(a: Column) -> Column:
    """An array over its sum."""
    return _once(a, lambda x: _once(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(x, lambda y: y / total)))


def softmax(log_p: Column) -> Column:
    return _scaled(_once(log_p, lambda a: _once(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))))


def fit_classifier(labelled: DataFrame, domains: list[str]) -> Classifier:
    """From stored rows ``labelled(k, fold, lang, size, buckets)``; ``k`` is the number of a domain, rows of fold 0 choose the factor."""
    n_k = len(domains)
    folds = {r["own"]: r["n"] for r in labelled.groupBy((F.col("fold") > 0).alias("own")).agg(F.count(F.lit(1)).alias("n")).collect()}
    split = bool(folds.get(True) and folds.get(False))
    rows = labelled.where("fold > 0") if split else labelled
    counts: dict[str, dict] = {f: {} for f in (*METADATA, "buckets")}
    total = [0] * n_k
    for r in rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():
        total[r["k"]] = r["n"]
    said = rows.select("k", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in METADATA))).alias("x")).where("x.v is not null").select("k", "x.f", "x.v")
    words = rows.select("k", F.lit("buckets").alias("f"), F.explode(F.transform("buckets", lambda b: b.cast("string"))).alias("v"))
    for r in said.union(words).groupBy("f", "v", "k").agg(F.count(F.lit(1)).alias("n")).collect():  # as many as values, or buckets, times domains
        counts[r["f"]].setdefault(r["v"], {})[r["k"]] = r["n"]
    prior = [math.log(n + SMOOTHING) for n in total]
    meta = {}
    for f in METADATA:
        known = counts[f]
        whole = [sum(v.get(k, 0) for v in known.values()) + SMOOTHING * (len(known) + 1) for k in range(n_k)]
        meta[f] = {v: [math.log((n.get(k, 0) + SMOOTHING) / whole[k]) for k in range(n_k)] for v, n in known.items()}
    table, n = {}, sum(total)
    spread = (n_k - 1) + SIGMAS * math.sqrt(2 * (n_k - 1))
    for v, seen in counts["buckets"].items():
        of_all = sum(seen.values())
        expected = [of_all * t / n for t in total]
        if of_all >= LEAST and sum((seen.get(k, 0) - e) ** 2 / e for k, e in enumerate(expected) if e > 0) > spread:
            own = [math.log((seen.get(k, 0) + SMOOTHING) / (total[k] + 2 * SMOOTHING)) for k in range(n_k)]
            table[int(v)] = [x - sum(own) / n_k for x in own]
    model = Classifier(domains, prior, meta, table, 0.0)
    if split and table:
        of = {f: F.col(f) for f in (*METADATA, "buckets")}
        held = labelled.where("fold = 0").select("k", model.base(of).alias("base"), model.evidence(of).alias("said"))
        weighed = held.select("k", *(_added(F.col("base"), _times(F.col("said"), w)).alias(f"w{i}") for i, w in enumerate(FACTORS)))
        likely = weighed.select(*(F.log(F.greatest(F.get(softmax(F.col(f"w{i}")), F.col("k")), F.lit(1e-12))).alias(f"w{i}") for i in range(len(FACTORS))))
        found = likely.agg(*(F.avg(f"w{i}").alias(f"w{i}") for i in range(len(FACTORS)))).first()
        model.factor = max((found[f"w{i}"], -w, w) for i, w in enumerate(FACTORS))[2]
    return model


Step = tuple[float, list[float]]


def rate_after(steps: list[Step], start: str | None = None, step: float = 1 / (1 + PULL), pull: float = PULL) -> tuple[Column, Column]:
    """The rate for the posterior ``p`` after gradient steps, and the rate before the last of them.

    Both begin at 1, or at the columns ``start`` and ``start_before``.  Every step has a momentum and the scaled
    residuals where that leads to: from there it goes against the gradient, and what is negative becomes 0.
    """
    first = (F.lit(1.0), F.lit(1.0)) if start is None else (F.col(start), F.col(f"{start}_before"))
    if not steps:
        return first
    past = F.expr("array(" + ", ".join("named_struct('m', " + f"{m!r}D" + ", 'r', array(" + ", ".join(f"{v!r}D" for v in r) + "))" for m, r in steps) + ")")
    along = lambda r: F.aggregate(F.zip_with("p", r, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    moved = lambda y, r: F.greatest(F.lit(0.0), y - step * (along(r) + pull * (y - 1)))
    both = F.aggregate(past, F.struct(first[0].alias("x"), first[1].alias("before")), lambda at, s: F.struct(_once(at["x"] + s["m"] * (at["x"] - at["before"]), lambda y: moved(y, s["r"])).alias("x"), at["x"].alias("before")))
    return both["x"], both["before"]


@dataclass
class Fit:
    """The steps, from which rates follow; by domain, the targets and what the rates reach, as shares of all tokens."""

    steps: list[Step]
    targets: dict[str, float]
    reached: dict[str, float]


def fit_rates(cells: DataFrame, domains: list[str], weights: dict[str, float] | float, steps: int = STEPS) -> Fit:
    """Nonnegative rates for ``cells(tokens, p)``, which has to be stored.

    ``weights``: the share of all tokens that each domain is to have (scaled to sum to 1), or a
    power: each domain's present expected share to that power, scaled.  Domains that no cell can
    belong to, and an empty table, are left as they are.  The descent ends when all targets are
    met, when it gains no more, or after ``steps`` steps; what it has come to is in ``reached``.
    """

    def totals(rows: DataFrame, rate: Column) -> list[float]:
        weighed = rows.select((F.col("tokens") * rate).alias("m"), "p")
        return [float(v or 0) for v in weighed.agg(*(F.sum(F.col("m") * F.get("p", F.lit(k))) for k in range(len(domains)))).first()]

    now = totals(cells, F.lit(1.0))
    whole = sum(now)
    if not whole:
        return Fit([], {}, {})
    share = [v / whole for v in now]
    raw = [share[k] ** weights if share[k] > 0 else 0.0 for k in range(len(domains))] if isinstance(weights, (int, float)) else [float(weights.get(d, 0.0)) for d in domains]
    if not sum(raw) > 0:
        raise ValueError("the targets' weights sum to nothing")
    target = [r / sum(raw) for r in raw]
    stored = cells.select("tokens", "p", F.lit(1.0).alias("rate"), F.lit(1.0).alias("rate_before"))
    every: list[Step] = []
    since: list[Step] = []
    worst = lambda a: max((abs(x - t) / max(t, CLOSE) for x, t, s in zip(a, target, share, strict=True) if s > 0), default=0.0)
    ahead, speed, momentum, still, least, before_gap = share, 0, 0.0, 0, math.inf, math.inf
    while len(every) < steps and worst(ahead) > CLOSE and still < STILL:
        gap = sum((a - t) ** 2 / s for a, t, s in zip(ahead, target, share, strict=True) if s > 0)
        if gap > before_gap:
            speed = 0  # it has overshot: momentum begins anew
        still, before_gap = (still + 1 if gap > 0.99 * least else 0), gap
        least = min(least, gap)
        residual = [(a - t) / s if s > 0 else 0.0 for a, t, s in zip(ahead, target, share, strict=True)]
        every.append((momentum, residual))
        since.append((momentum, residual))
        if len(since) == KEPT_STEPS:
            rate, before = rate_after(since, "rate")
            stored, since = materialise(stored.select("tokens", "p", rate.alias("rate"), before.alias("rate_before")), "cells"), []
        speed += 1
        momentum = (speed - 1) / (speed + 2)
        rate, before = rate_after(since, "rate")
        ahead = [v / whole for v in totals(stored.select("tokens", "p", rate.alias("x"), before.alias("x_before")), F.col("x") + momentum * (F.col("x") - F.col("x_before")))]
    rate, _ = rate_after(since, "rate")
    reached = [v / whole for v in totals(stored, rate)]
    return Fit(every, dict(zip(domains, target, strict=True)), dict(zip(domains, reached, strict=True)))


def membership(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with ``__tokens`` and ``__p``, whole numbers in proportion to the posterior of each of the domains, and the domains; see :func:`mix`."""
    named = labelled.where("id is not null and domain is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    named = materialise(named.join(docs.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi"), "named")
    domains = [r["domain"] for r in named.select("domain").distinct().orderBy("domain").limit(MOST_DOMAINS + 1).collect()]
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    tokens = n_tokens(F.col(text_col).cast("string"))
    if not domains:
        return docs.withColumns({"__tokens": tokens, "__p": F.array().cast("array<int>")}), []
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")).cast("int") - 1
    known = named.select("id", number.alias("k"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(FITTED).withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(4)))
    own = features(docs, text_col)
    chosen = drawn.select(F.col("id").alias("__id"), F.col("k").alias("__k"), F.col("fold").alias("__fold"))  # FITTED rows at most
    fitted = docs.join(F.broadcast(chosen), F.col(id_col).cast("long") == F.col("__id")).select(F.col("__k").alias("k"), F.col("__fold").alias("fold"), *(c.alias(f) for f, c in own.items()))
    model = fit_classifier(materialise(fitted, "labelled"), domains)
    grain = max(GRAIN, 4 * len(domains))
    scored = (
        docs.withColumns({"__tokens": tokens, **{f"__{f}": c for f, c in own.items()}})
        .withColumn("__p", F.transform(softmax(model.scores({f: F.col(f"__{f}") for f in own})), lambda p: F.round(p * grain).cast("int")))
        .drop(*(f"__{f}" for f in own))
    )
    # Rows without an id are spread over keys, which the condition then refuses, instead of all in one task.
    has = F.col(id_col).cast("long").isNotNull()
    keyed = scored.withColumns({"__key": F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"), F.lit("no id"))), "__has": has})
    found = keyed.join(known.select(F.col("id").alias("__id"), F.col("k").alias("__k")), (F.col("__key") == F.col("__id")) & F.col("__has"), "left")
    own_one = F.transform(F.sequence(F.lit(0), F.lit(len(domains) - 1)), lambda k: F.when(k == F.col("__k"), 1).otherwise(0))
    return found.withColumn("__p", F.when(F.col("__k").isNull(), F.col("__p")).otherwise(own_one)).drop("__key", "__has", "__id", "__k"), domains


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | float = 0.5, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("n_tokens", "rate", "copies")) -> DataFrame:
    """``docs`` with ``n_tokens``, ``rate`` and ``copies``, or columns of other ``names``.

    ``labelled(id, domain)`` names the domain of some documents.  ``copies`` is the rate rounded
    down or up by a number drawn from the id's hash, so that it is right on average and the same
    in every run.

    * Null texts have no tokens and no words; they and null features have rates like others.
    * Null ids, and null domains, label nothing; of several domains of an id the least counts.
    * Repeated rows are documents of their own; rows that share an id are rounded alike.
    * Without labelled rows, or without tokens, every rate is 1; an empty table gives an empty table.
    * Extra columns stay; columns named like the new ones are replaced.
    """
    seen, domains = membership(docs, labelled, id_col, text_col)
    share = _scaled(F.col("__p"))
    rate = F.lit(1.0)
    if domains:
        cells = seen.groupBy("__p").agg(F.sum("__tokens").alias("tokens")).select("tokens", share.alias("p"))
        rate, _ = rate_after(fit_rates(materialise(cells, "cells"), domains, weights).steps)
    drawn = (F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("mix")), 11) / F.lit(float(2**53))).cast("double")
    tokens_name, rate_name, copies_name = names
    out = seen.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c == "p"}).withColumn("p", share)
    out = out.withColumns({"__rate": rate}).withColumn("__copies", F.floor(F.col("__rate") + drawn).cast("int")).drop("p", "__p").withColumnRenamed("__own_p", "p")
    kept = [c for c in docs.columns if c not in names]
    return out.select(*kept, F.col("__tokens").alias(tokens_name), F.col("__rate").alias(rate_name), F.col("__copies").alias(copies_name))


def resample(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As many rows of each document as its rate comes to; all columns, whatever their names, stay as they are.

    See :func:`mix` for null, repeated and empty rows.
    """
    mixed = mix(docs, labelled, weights, id_col, text_col, ("__mix_tokens", "__mix_rate", "__mix_copies"))
    return mixed.where("__mix_copies > 0").withColumn("__mix_nth", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*docs.columns)
