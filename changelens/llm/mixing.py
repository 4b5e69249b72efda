"""Mixing to target weights by soft membership, with DataFrame functions only.

Logistic regression learnt from a labelled table gives each document a posterior over domains.
Document rates start at one and follow projected gradient steps of a least-squares problem: the
expected tokens of each domain, summed over documents by rate and posterior, shall meet the targets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import let, stored
from changelens.operators.barrier import bind

# Labelled documents that the classifier learns from at most: those with the smallest hash of their id.
SAMPLE = 20_000
# Features besides the words of a text: symbols, mostly capitals, few words, mostly repeated words.
MARKS = ["<some symbols>", "<many symbols>", "<capitals>", "<short>", "<repeats>"]
# A feature is used if its share of a domain's documents is this many standard errors from its share overall,
# and it is in this share of the domain's documents: what one group of copies has in common is no mark of a domain.
STANDARD_ERRORS = 4.0
LEAST_SHARE = 0.1
FEATURES = 200
# Weight of the squared weights in the fit, against one document each.
RIDGE = 1.0
STEPS = 30
TOLERANCE = 1e-4
# Steps end when one lowers the error by a smaller share than this.
STALLED = 0.01
# A rate this close to a whole number is that number but for rounding.
ROUNDING = 1e-9
SEED = "mix-1"


def words_in(text: Column) -> Column:
    """A text's words in lower case, without punctuation and symbols."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?()<>\"'#*$%&|]+"), "")


def marks_of(text: Column, words: Column) -> Column:
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    symbols, n = without("[#*$%&|<>]+"), F.size(words)
    marked = [symbols * 20 > n, symbols * 2 > n, without("[A-Z]+") * 5 > F.char_length(text), n < 20, F.size(F.array_distinct(words)) * 10 < n * 3]
    return F.array_compact(F.array(*[F.when(is_so, F.lit(name)) for is_so, name in zip(marked, MARKS)]))


@dataclass
class Classifier:
    """Domains with their scores for a text without any feature, and what each feature adds to each domain's score."""

    domains: list[str]
    priors: list[float]
    weights: dict[str, list[float]]

    def posteriors(self, words: Column, marks: Column) -> Column:
        """The posterior of each domain, in order; the priors for a text without features."""

        def soft(scores: Column) -> Column:
            top = F.array_max(scores)
            shares = F.transform(scores, lambda s: F.exp(s - top))
            return let(shares, lambda e: let(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda z: F.transform(e, lambda x: x / z)))

        priors = F.array(*map(F.lit, self.priors))
        if not self.weights:
            return soft(priors)
        known = F.array(*map(F.lit, self.weights))
        rows = F.array(*[F.array(*map(F.lit, row)) for row in self.weights.values()])
        hits = F.concat(F.array_intersect(words, known), F.array_intersect(marks, known))
        added = F.aggregate(
            hits, priors, lambda acc, w: F.zip_with(acc, F.element_at(rows, F.array_position(known, w).cast("int")), lambda a, b: a + b)
        )
        return let(added, soft)


def logistic(held: np.ndarray, domain: np.ndarray, k: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights (features + 1, k) of multinomial logistic regression by Newton steps; the last row are the scores without a feature.

    Those are not penalised, so the posteriors' mean over the given documents is each domain's share of them.
    """
    x = np.column_stack((held.astype(float), np.ones(len(held))))
    n, f = x.shape
    y = np.eye(k)[domain]
    penalty = np.append(np.full(f - 1, ridge), 1e-6)
    w = np.zeros((f, k))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scores = x @ w
        scores -= scores.max(axis=1, keepdims=True)
        logs = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return float(-(logs * y).sum() + 0.5 * (penalty[:, None] * w * w).sum()), np.exp(logs)

    before, p = loss(w)
    for _ in range(50):
        gradient = x.T @ (p - y) + penalty[:, None] * w
        if np.abs(gradient).max() < 1e-6 * n:
            break
        hessian = np.zeros((k, f, k, f))
        for i in range(k):
            for j in range(k):
                hessian[i, :, j] = (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x + (i == j) * np.diag(penalty)
        step = np.linalg.lstsq(hessian.reshape(k * f, k * f), gradient.T.reshape(-1), rcond=None)[0].reshape(k, f).T
        size = 1.0
        while size > 1e-6:
            after, moved = loss(w - size * step)
            if after <= before:
                break
            size /= 2
        if size <= 1e-6:
            break
        w, before, p = w - size * step, after, moved
    return w


def learn(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label_id: str, domain: str, sample: int = SAMPLE) -> Classifier:
    """Logistic regression on the features of at most ``sample`` labelled documents.

    Where a text does not tell its domain, its posterior is the share that each domain has of such texts.
    Labels without a domain or a document are left out; a document labelled twice counts for each.
    Without any labelled document there is one domain, ``all``.
    """
    given = labels.select(labels[label_id].alias("_id"), labels[domain].cast("string").alias("domain")).filter("_id is not null and domain is not null")
    chosen = given.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "domain").limit(sample)
    # At most ``sample`` rows, so they go to the documents; no text is shuffled.
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("t")).join(F.broadcast(chosen), "_id")
    rows = bind(rows, words=words_in(F.col("t")))
    features = F.concat(F.array_distinct("words"), marks_of(F.col("t"), F.col("words")))
    rows = stored(rows.select("_id", "domain", features.alias("features")))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Classifier(["all"], [0.0], {})
    domains, total = sorted(sizes), sum(sizes.values())
    held = rows.select("domain", F.explode("features").alias("f")).groupBy("f")
    counts = held.agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)])
    wide = [F.col(f"n{i}") >= LEAST_SHARE * sizes[d] for i, d in enumerate(domains)]
    size = np.array([sizes[d] for d in domains], float)
    clear = []
    for row in counts.filter(F.array_contains(F.array(*wide), True)).orderBy("f").collect():
        n = np.array(row[1:], float)
        overall = (n.sum() + 1.0) / (total + 2.0)
        off = np.abs(n / size - overall) / np.sqrt(overall * (1 - overall) / size)
        if off.max() > STANDARD_ERRORS:
            clear.append((-off.max(), row["f"]))
    names = [name for _, name in sorted(clear)[:FEATURES]]
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    place = F.transform(F.array_intersect("features", known), lambda x: F.array_position(known, x) - 1)
    # Many rows of one id count up to the sample's size as well: the driver fits on this many at most.
    seen = rows.select("domain", place.alias("at"), F.xxhash64(F.col("_id").cast("string")).alias("h")).orderBy("h", "domain", "at").limit(sample).collect()
    x = np.zeros((len(seen), len(names)), np.int8)
    for i, r in enumerate(seen):
        x[i, r["at"]] = 1
    w = logistic(x, np.array([domains.index(r["domain"]) for r in seen]), len(domains))
    return Classifier(domains, w[-1].tolist(), dict(zip(names, w[:-1].tolist())))


def memberships(docs: DataFrame, model: Classifier, text: str, id_col: str) -> DataFrame:
    """(id, digest, tokens, p) of every row: p holds the posteriors in the order of the model's domains."""
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    rows = bind(rows, words=words_in(F.col("t")))
    p = model.posteriors(F.col("words"), marks_of(F.col("t"), F.col("words")))
    return rows.select("id", F.xxhash64("t").alias("digest"), F.size("words").cast("bigint").alias("tokens"), p.alias("p"))


def fit_rates(rows: DataFrame, goals: list[float], least: float = 0.0, most: float = math.inf) -> list[np.ndarray]:
    """The steps of the projected gradient: rate = 1, then rate - p . step within ``least`` and ``most`` for each step.

    With the expected tokens e = sum(tokens rate p) and G = sum(tokens p p'), the steps lower
    (e - goals)' G^-1 (e - goals). In the norm that weighs a rate by its document's tokens this has a
    gradient p . G^-1 (e - goals) of slope at most one, so a full step never raises it; without the
    bounds the first one is exact. Every pass over the rows gives sums of domains by domains.
    """
    k = len(goals)
    goals = np.array(goals)
    p = [F.get("p", i) for i in range(k)]
    square = rows.agg(*[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = [x or 0.0 for x in square]
    gram = gram + np.triu(gram, 1).T
    gram += np.eye(k) * max(1e-12, 1e-9 * np.trace(gram))
    steps: list[np.ndarray] = []
    scale, before = max(1.0, float(np.abs(goals).sum())), math.inf
    for _ in range(STEPS):
        rated = bind(rows.select("tokens", "p"), rate=rate_of(steps, k, least, most))
        found = rated.agg(*[F.sum(F.col("tokens") * F.col("rate") * p[i]).alias(f"e{i}") for i in range(k)]).first()
        residual = np.array([x or 0.0 for x in found]) - goals
        step = np.linalg.solve(gram, residual)
        error = float(residual @ step)
        if np.abs(residual).max() <= TOLERANCE * scale or error > (1 - STALLED) * before:
            break
        before = error
        steps.append(step)
    return steps


def rate_of(steps: list[np.ndarray], k: int, least: float = 0.0, most: float = math.inf) -> Column:
    if not steps:
        return F.lit(1.0)

    def moved(rate: Column, step: Column) -> Column:
        change = F.lit(0.0)
        for i in range(k):
            change = change + F.get("p", F.lit(i)) * F.get(step, F.lit(i))
        return F.least(F.lit(most), F.greatest(F.lit(least), rate - change))

    taken = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
    return F.aggregate(taken, F.lit(1.0), moved)


def copies_of(rate: Column, id_: Column, digest: Column, seed: str) -> Column:
    """A whole number of copies whose expectation is the rate, by a hash of the row's id and text."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_.cast("string"), digest), 11) / F.lit(float(1 << 53))
    near = F.round(rate)
    return F.when(F.abs(rate - near) <= ROUNDING, near).otherwise(F.floor(rate + draw)).cast("bigint")


def mixed(
    docs: DataFrame,
    labels: DataFrame,
    domain: str,
    weights: dict[str, float] | None = None,
    multiples: dict[str, float] | None = None,
    bounds: tuple[float, float] | None = None,
    text: str = "text",
    id_col: str = "doc_id",
    label_id: str = "doc_id",
    sample: int = SAMPLE,
    seed: str = SEED,
) -> DataFrame:
    """(id, digest, tokens, domain, posterior, rate, copies) of every row; domain is the likeliest one.

    Targets are the domains' shares of all tokens (``weights``), or multiples of what they are
    expected to have (``multiples``); a domain not named keeps what it has. No rate leaves ``bounds``;
    without them rates are at least 0, and with multiples in the range from the least to the greatest of these. Null and empty texts have
    no tokens, the prior as posterior and the rate that this gives. Repeated rows get equal rates;
    an empty table gives an empty result; other columns are ignored.
    """
    model = learn(docs, labels, text, id_col, label_id, domain, sample)
    rows = stored(memberships(docs, model, text, id_col))
    k = len(model.domains)
    first = rows.agg(*[F.sum(F.col("tokens") * F.get("p", i)).alias(f"s{i}") for i in range(k)]).first()
    own = dict(zip(model.domains, (x or 0.0 for x in first)))
    asked = [(multiples or {}).get(d, 1.0) for d in model.domains]
    if weights:
        goals = [weights[d] * sum(own.values()) if d in weights else own[d] for d in model.domains]
    else:
        goals = [m * own[d] for m, d in zip(asked, model.domains)]
    least, most = bounds or ((0.0, math.inf) if weights else (min(asked), max(asked)))
    rate = rate_of(fit_rates(rows, goals, least, most), k, least, most)
    names = F.array(*map(F.lit, model.domains))
    likeliest = F.array_position("p", F.array_max("p")).cast("int")
    out = rows.select(
        F.col("id").alias(id_col), "digest", "tokens", F.element_at(names, likeliest).alias("domain"),
        F.array_max("p").alias("posterior"), rate.alias("rate"),
    )
    return out.withColumn("copies", copies_of(F.col("rate"), F.col(id_col), F.col("digest"), seed))


def mixed_documents(docs: DataFrame, labels: DataFrame, domain: str, text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as their copies say, with all their columns."""
    rates = mixed(docs, labels, domain, text=text, id_col=id_col, **options)
    other = rates.filter("copies <> 1").groupBy(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).agg(F.max("copies").alias("_copies"))
    other = stored(other)
    same = docs[id_col].eqNullSafe(other["_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == other["_digest"])
    names = [docs[c] for c in docs.columns]
    joined = docs.join(other, same, "left").select(*names, F.coalesce("_copies", F.lit(1).cast("bigint")).alias("_copies"))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).drop("_copies", "_copy")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: toxic, else good or plain by quality."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    return labels.select("doc_id", kind.alias("domain"))
