"""Mixing sources to target weights by soft membership, in DataFrame operations only.

The labels table names three domains: low (quality 0), toxic (good but toxic) and clean. A naive Bayes classifier learnt from it
(normal densities of text shares, and the presence of its most telling words) gives every document the posterior
of each domain. Rates x >= 0 are then fitted by projected-gradient least squares: the expected token totals
sum_i x_i t_i p_id shall match the targets. In the metric of sum_i t_i p_i p_i' over the rows with x_i > 0, with a little of that over all rows for
damping, a unit step is safe, so one iteration is one aggregation of nine numbers, x <- max(0, x - p.v), from x = 1; a document's rate is a function of its posteriors and
of the few vectors v, so no rates are stored between iterations.

The fit of the classifier takes labelled rows chosen by a hash of doc_id, `max_fit` at most or so (a documented bound of the fit alone), and keeps at most
`words` words a domain. Everything else covers all rows and whole texts.

Defined results: null or empty text has 0 tokens, the prior as posterior, and a rate like others; without labels all rows are
of the clean domain; a domain without rows cannot meet its target and the others do; null doc_ids are allowed; rows repeat as
they come; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrag.llm.common import stored

DOMAINS = ("low", "toxic", "clean")
_MARKS = "!#$%&*|<>{}[]=_~^\\/@+\"()"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def shares(text: Column) -> list[tuple[str, Column]]:
    """Words of the text and the shares whose densities tell the domains apart."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # single blanks between words, without regular expressions
    words = F.array_remove(F.split(F.translate(F.lower(t), "\n\t\r.,;:" + _MARKS, "    "), " "), "")
    n = F.greatest(F.length(t), F.lit(1))
    return [
        ("words", words),
        ("n", n.cast("double")),
        ("f0", F.sqrt((F.length(t) - F.length(_without(t, _MARKS))) / n)),
        ("f1", F.sqrt((F.length(t) - F.length(_without(t, _UPPER))) / n)),
        ("f2", F.sqrt((F.length(t) - F.length(_without(t, _DIGITS))) / n)),
    ]


def _features(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, tokens, uniq (distinct words) and f0..f4 of every row."""
    base = docs.select(*keep, F.explode(F.array(F.struct(*(c.alias(k) for k, c in shares(F.col("text")))))).alias("__s"))
    base = base.select(*(f"`{c}`" for c in base.columns if c != "__s"), "__s.*")
    base = _bound(base, tokens=F.size("words").cast("long"), uniq=F.array_distinct("words")).drop("words")
    m = F.greatest(F.col("tokens"), F.lit(1))
    return base.withColumn("f3", F.size("uniq") / m).withColumn("f4", F.least(F.col("n") / m, F.lit(40.0)))


N_SHARES = 5


def domains(labels: DataFrame) -> DataFrame:
    d = F.when(F.col("quality").cast("int") < 1, 0).when(F.col("toxic").cast("int") > 0, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("l_id"), d.alias("d"))


def fit_domains(docs: DataFrame, labels: DataFrame, max_fit: int = 12_000, words: int = 96, seed: int = 7) -> dict | None:
    """Priors, densities of the shares and word evidence by domain; None without labelled rows."""
    rated = domains(labels)
    n = rated.count()
    if n > max_fit:
        rated = rated.where(F.pmod(F.xxhash64(F.lit(seed), "l_id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / n))
    # bounded by max_fit rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rated), F.col("doc_id") == F.col("l_id")).select("d", "text")
    rows = stored(_features(rows, [F.col("d")]).where("tokens > 0"), "mixing-fit")
    names = [f"f{k}" for k in range(N_SHARES)]
    found = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f"m_{f}") for f in names), *(F.stddev_pop(f).alias(f"s_{f}") for f in names)).collect()
    if not found:
        return None
    by = {r.d: r for r in found}
    total = sum(r.n for r in found)
    count = {d: by[d].n if d in by else 0 for d in range(3)}
    hits = rows.select("d", F.explode("uniq").alias("w")).groupBy("w").agg(*(F.sum((F.col("d") == d).cast("int")).alias(f"c{d}") for d in range(3)))
    evidence: dict[str, list[float]] = {}
    absent = [0.0, 0.0, 0.0]  # log-probability that a text holds none of the words
    for d in range(3):
        if not count[d] or count[d] == total:
            continue
        n1, n0 = count[d], total - count[d]
        c1 = F.col(f"c{d}")
        c0 = sum((F.col(f"c{e}") for e in range(3) if e != d), F.lit(0))
        z = (c1 / n1 - c0 / n0) / F.sqrt((c1 + c0 + 1) / total * (1 - (c1 + c0) / (total + 1)) * (1 / n1 + 1 / n0))
        top = hits.where((c1 + c0 >= 8) & (F.abs(z) > 6)).orderBy(F.abs(z).desc(), "w").limit(words).collect()  # bounded by `words`
        for r in top:
            if r.w in evidence:
                continue
            c = [r[f"c{e}"] for e in range(3)]
            rate = [(c[e] + 0.5) / (count[e] + 1) if count[e] else 0.5 for e in range(3)]
            evidence[r.w] = [math.log(x / (1 - x)) for x in rate]
            absent = [a + math.log(1 - x) for a, x in zip(absent, rate)]
    spread = lambda r, f: max(r[f"s_{f}"] or 0.0, 0.02)
    return {
        "absent": absent,
        "prior": [(count[d] + 1) / (total + 3) if count[d] else 1e-9 for d in range(3)],
        "mean": [[by[d][f"m_{f}"] if d in by else 0.0 for f in names] for d in range(3)],
        "sd": [[spread(by[d], f) if d in by else 1.0 for f in names] for d in range(3)],
        "words": evidence,
    }


def _bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns that are computed once a row, however often they are used later (a one-element explode keeps the
    optimizer from copying the expressions into every use)."""
    made = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("__made")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return rows.select(*kept, made).select(*kept, *(F.col(f"__made.{k}").alias(k) for k in columns))


def _posteriors(rows: DataFrame, model: dict | None) -> DataFrame:
    """Adds P(domain) to rows of `_features`."""
    if model is None:
        return rows.withColumns({"p_low": F.lit(0.0), "p_toxic": F.lit(0.0), "p_clean": F.lit(1.0)})
    rows = _bound(rows, **{f"s{d}": c for d, c in enumerate(_scores(model))})
    score = [F.col(f"s{d}") for d in range(3)]
    rows = _bound(rows, **{f"e{d}": F.exp(x - F.greatest(*score)) for d, x in enumerate(score)})
    total = F.col("e0") + F.col("e1") + F.col("e2")
    return _bound(rows, **{f"p_{k}": F.col(f"e{d}") / total for d, k in enumerate(DOMAINS)})


def _scores(model: dict) -> list[Column]:
    """Log of prior times likelihood of a row of `_features`, by domain."""
    known = F.lit(0.0)
    score: list[Column] = []
    for d in range(3):
        s = F.lit(math.log(model["prior"][d])) + F.when(F.col("tokens") > 0, model["absent"][d]).otherwise(0.0)
        for k in range(N_SHARES):
            m, sd = model["mean"][d][k], model["sd"][d][k]
            z = (F.col(f"f{k}") - m) / sd
            # heavy tails: a share far from all domains says little
            s = s + F.when(F.col("tokens") > 0, -F.log1p(z * z / 5) * 3 - math.log(sd)).otherwise(known)
        if model["words"]:
            pairs = sorted(model["words"].items())
            table = F.create_map(*(x for w, e in pairs for x in (F.lit(w), F.lit(float(e[d])))))
            s = s + F.aggregate("hits", F.lit(0.0), lambda a, w: a + F.element_at(table, w))
        score.append(s)
    return score


def _scored(docs: DataFrame, model: dict | None, keep: list[Column]) -> DataFrame:
    rows = _features(docs, keep)
    words = sorted(model["words"]) if model else []
    rows = _bound(rows, hits=F.array_intersect("uniq", F.array(*map(F.lit, words)))) if words else rows
    return _posteriors(rows.drop("uniq"), model)


def _solve(g: list[list[float]], r: list[float]) -> list[float]:
    """g v = r for a small symmetric matrix, with a ridge for domains without rows."""
    n = len(r)
    ridge = 1e-9 * (sum(g[i][i] for i in range(n)) or 1.0)
    a = [[*(g[i][j] + ridge * (i == j) for j in range(n)), r[i]] for i in range(n)]
    for i in range(n):
        p = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[p] = a[p], a[i]
        for k in range(n):
            if k != i:
                f = a[k][i] / a[i][i]
                a[k] = [x - f * y for x, y in zip(a[k], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


DAMPING = 0.05  # share of the metric of all rows


def rate_of(steps: list[list[float]]) -> Column:
    """The rate after the projected steps, from a row's posteriors."""
    if not steps:
        return F.lit(1.0)
    vectors = F.array(*(F.array(*(F.lit(float(x)) for x in v)) for v in steps))
    p = [F.col(f"p_{k}") for k in DOMAINS]
    return F.aggregate(vectors, F.lit(1.0), lambda x, v: F.greatest(F.lit(0.0), x - sum((p[k] * v[k] for k in range(1, 3)), p[0] * v[0])))


def fit_rates(scored: DataFrame, targets: dict[str, float] | None, anchor: dict[str, float] | None = None, iterations: int = 24, close: float = 1e-3) -> tuple[list[list[float]], dict]:
    """Step vectors whose rates bring the expected tokens of each domain to the target.

    targets: shares of the corpus's tokens by domain. anchor: instead, at most so many tokens for one of the clean domain,
    never more than there are (nothing is asked for that must be repeated). Targets that cannot be met within `close` in `iterations`
    steps, or that three steps came no nearer (by 2 %), as those of a domain without rows, are reached as near as it goes, with a warning.
    """
    p = [F.col(f"p_{k}") for k in DOMAINS]
    t = F.col("tokens")

    def sums(steps):
        """Expected tokens by domain at the rates of the steps, and the metric over the rows whose rate is not 0."""
        rows = scored.withColumn("__x", rate_of(steps)).withColumn("__a", F.when(F.col("__x") > 0, t).otherwise(0))
        row = rows.agg(*(F.sum(F.col("__a") * p[i] * p[j]).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)), *(F.sum(t * p[i] * F.col("__x")).alias(f"t{i}") for i in range(3))).first()
        return [row[f"t{i}"] or 0.0 for i in range(3)], [[row[f"g{min(i, j)}{max(i, j)}"] or 0.0 for j in range(3)] for i in range(3)]

    have, whole = sums([])
    if anchor is not None:
        want = [min(have[i], anchor.get(k, 1.0) * have[2]) for i, k in enumerate(DOMAINS)]
    else:
        want = [targets.get(k, 0.0) * sum(have) for k in DOMAINS]
    steps: list[list[float]] = []
    now, active = have, whole
    size = math.sqrt(sum(x * x for x in want)) or 1.0
    least, idle = math.inf, 0
    while sum(have) and len(steps) < iterations:
        r = [a - b for a, b in zip(now, want)]
        norm = math.sqrt(sum(x * x for x in r))
        least, idle = (norm, 0) if norm < 0.98 * least else (least, idle + 1)
        if norm <= close * size or idle == 3:
            break
        steps.append(_solve([[a + DAMPING * w for a, w in zip(x, y)] for x, y in zip(active, whole)], r))
        now, active = sums(steps)
    left = math.sqrt(sum((a - b) ** 2 for a, b in zip(now, want)))
    if left > close * size:
        warnings.warn(f"mixing: the rates miss the targets by {left / size:.3f} of their length after {len(steps)} steps: tokens {now}, targets {want}", stacklevel=2)
    return steps, {"have": have, "want": want, "got": now}


def copies_of(rate: Column, doc_id: Column, seed: int = 7) -> Column:
    """The rate rounded up or down by a seeded hash of doc_id, so that copies have the rate as their mean. Rows of one doc_id draw alike."""
    u = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def _drawn_by() -> Column:
    """What a stored row is drawn by: its doc_id, without one its number, so that many rows without doc_id draw apart."""
    return F.coalesce("doc_id", -1 - F.col("__n"))


#: Shares of tokens that the query asks for.
TARGETS = {"low": 0.05, "toxic": 0.02, "clean": 0.93}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_fit: int = 12_000) -> DataFrame:
    """doc_id, tokens, p_low, p_toxic, p_clean, rate, copies of every row."""
    model = fit_domains(docs, labels, max_fit)
    number = F.monotonically_increasing_id().alias("__n")  # stored, so it stays what it is
    scored = stored(_scored(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), number]).select("doc_id", "__n", "tokens", *(f"p_{k}" for k in DOMAINS)), "mixing")
    steps, _ = fit_rates(scored, targets)
    out = _bound(scored, rate=rate_of(steps))
    return out.withColumn("copies", copies_of(F.col("rate"), _drawn_by())).drop("__n")


#: For one token of the clean domain at most so many of the others, in the pipeline.
ANCHOR = {"low": 0.05, "toxic": 0.0, "clean": 1.0}


def select(docs: DataFrame, labels: DataFrame, anchor: dict[str, float] = ANCHOR, max_fit: int = 12_000) -> DataFrame:
    """The rows of docs that the rates keep (copies >= 1, each once), with all their columns and no shuffle of texts.

    The rows are stored once beside their posteriors, which costs less than to make the features of all texts again after the fit.
    """
    model = fit_domains(docs, labels, max_fit)
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row")
    key = F.col("doc_id").cast("long").alias("doc_id")
    number = F.monotonically_increasing_id().alias("__n")
    scored = stored(_scored(docs, model, [whole, key, number]).select("__row", "doc_id", "__n", "tokens", *(f"p_{k}" for k in DOMAINS)), "mixing")
    steps, _ = fit_rates(scored, None, anchor)
    rows = _bound(scored, rate=rate_of(steps))
    return rows.where(copies_of(F.col("rate"), _drawn_by()) >= 1).select("__row.*")
