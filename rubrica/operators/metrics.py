"""Aggregations over scored rows: registry, families, breakdowns, groups, resampling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubrica.sources.staging import staged

Aggregation = Callable[..., Column]
AGGREGATIONS: dict[str, Aggregation] = {}
#: metric -> (aggregation, whether higher is better); fixed values.
METRICS: dict[str, tuple[str, bool]] = {
    "acc": ("mean", True), "acc_norm": ("mean", True), "acc_mutual_info": ("mean", True), "exact_match": ("mean", True), "anls": ("mean", True), "f1": ("f1", True),
    "mcc": ("matthews_corrcoef", True), "bleu": ("bleu", True), "chrf": ("chrf", True), "ter": ("ter", False), "brier_score": ("brier_score", False), "perplexity": ("perplexity", False),
    "word_perplexity": ("weighted_perplexity", False), "byte_perplexity": ("weighted_perplexity", False), "bits_per_byte": ("bits_per_byte", False), "bypass": ("bypass", True),
}
#: Metrics of a request type, where a task names none; fixed values.
DEFAULTS = {"loglikelihood": ("perplexity", "acc"), "multiple_choice": ("acc", "acc_norm"), "generate_until": ("exact_match",), "generate_until_multi_round": ("exact_match",), "loglikelihood_rolling": ("word_perplexity", "byte_perplexity", "bits_per_byte")}


def register(name: str) -> Callable[[Aggregation], Aggregation]:
    def add(f: Aggregation) -> Aggregation:
        if name in AGGREGATIONS:
            raise ValueError(f"there is an aggregation {name!r} already")
        AGGREGATIONS[name] = f
        return f

    return add


@register("mean")
def mean(x: Column) -> Column:
    return F.avg(x)


@register("median")
def median(x: Column | str) -> Column:
    """The upper middle of the sorted values of a column, given by name; exact. Tasks send counts of different values, not rows."""
    name = x if isinstance(x, str) else str(x).removeprefix("Column<'").removesuffix("'>")
    return F.expr(f"percentile_disc(0.5) within group (order by `{name}` desc)")


@register("perplexity")
def perplexity(ll: Column) -> Column:
    return F.exp(-F.avg(ll))


@register("weighted_perplexity")
def weighted_perplexity(ll: Column, weight: Column) -> Column:
    return F.exp(-F.sum(ll) / F.sum(weight))


@register("bits_per_byte")
def bits_per_byte(ll: Column, n_bytes: Column) -> Column:
    return -(F.sum(ll) / F.sum(n_bytes)) / F.log(F.lit(2.0))


def confusion(gold: Column, pred: Column) -> dict[str, Column]:
    """Counts of a binary prediction, both sides boolean."""
    return {"tp": F.count_if(gold & pred), "fp": F.count_if(~gold & pred), "fn": F.count_if(gold & ~pred), "tn": F.count_if(~gold & ~pred)}


@register("f1")
def f1(gold: Column, pred: Column) -> Column:
    c = confusion(gold, pred)
    return F.coalesce(F.try_divide(2.0 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]), F.lit(0.0))


@register("matthews_corrcoef")
def matthews(gold: Column, pred: Column) -> Column:
    """0 where a class is never predicted or never true."""
    c = {k: v.cast("double") for k, v in confusion(gold, pred).items()}
    den = F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    return F.when(den == 0, 0.0).otherwise((c["tp"] * c["tn"] - c["fp"] * c["fn"]) / den)


def matthews_classes(gold: Column, pred: Column, classes: int) -> Column:
    """MCC of class numbers 0 to classes - 1, from each class's counts; 0 where one side has one class alone."""
    total, right = F.count("*").cast("double"), F.count_if(gold == pred).cast("double")
    counts = [(F.count_if(gold == k).cast("double"), F.count_if(pred == k).cast("double")) for k in range(classes)]
    both, golds, preds = (sum((f(g, p) for g, p in counts), F.lit(0.0)) for f in (lambda g, p: g * p, lambda g, p: g * g, lambda g, p: p * p))
    den = F.sqrt((total * total - golds) * (total * total - preds))
    return F.when(den == 0, 0.0).otherwise((right * total - both) / den)


@register("brier_score")
def brier(probabilities: Column, gold: Column) -> Column:
    """Mean over rows of the squared distance between probabilities and the one-hot target."""
    return F.avg(F.aggregate(F.transform(probabilities, lambda p, i: F.pow(p - (i == gold).cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


@register("bypass")
def bypass(x: Column) -> Column:
    return F.lit(999.0)


def stderr(x: Column) -> Column:
    """Standard error of the mean; null for one row."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def binary_report(gold: Column, pred: Column) -> dict[str, Column]:
    """Accuracy with its error, precision, recall, F1 and the shares of positives, from one pass."""
    c = confusion(gold, pred)
    right = (gold == pred).cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return {
        "accuracy": F.avg(right),
        "accuracy_stderr": stderr(right),
        "precision": ratio(c["tp"], c["tp"] + c["fp"]),
        "recall": ratio(c["tp"], c["tp"] + c["fn"]),
        "f1": ratio(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]),
        "yes_ratio": F.avg(gold.cast("double")),
        "pred_yes_ratio": F.avg(pred.cast("double")),
        "n": F.count("*"),
    }


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]


# --- families


def macro(df: DataFrame, score: Column, by: Sequence[str]) -> DataFrame:
    """Mean over groups of the groups' means."""
    return df.groupBy(*by).agg(F.avg(score).alias("m")).agg(F.avg("m").alias("macro"), F.count("*").alias("groups"))


def breakdown(df: DataFrame, score: Column, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, key, value, n): overall and along each dimension, from one scan by grouping sets."""
    keyed = df.select(*(F.col(d).cast("string").alias(d) for d in dimensions), score.alias("_score"))
    sets = keyed.groupingSets([[], *([F.col(d)] for d in dimensions)], *map(F.col, dimensions)).agg(F.avg("_score").alias("value"), F.count("*").alias("n"), F.grouping_id().alias("_g"))
    k = len(dimensions)
    where = F.lit("overall")
    key = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        mine = F.col("_g") == F.lit((1 << k) - 1 - (1 << (k - 1 - i)))
        where, key = F.when(mine, d).otherwise(where), F.when(mine, F.col(d)).otherwise(key)
    return sets.select(where.alias("dimension"), key.alias("key"), "value", "n")


def all_correct(df: DataFrame, hit: Column, by: Sequence[str]) -> DataFrame:
    """Adds up groups of which every member is a hit."""
    return df.groupBy(*by).agg(F.bool_and(hit).alias("all")).agg(F.avg(F.col("all").cast("double")).alias("all_correct"), F.count("*").alias("groups"))


def all_correct_stderr(df: DataFrame, hit: Column, by: Sequence[str]) -> DataFrame:
    """The error of the share of groups of which every member is a hit."""
    return df.groupBy(*by).agg(F.bool_and(hit).cast("double").alias("all")).agg(stderr(F.col("all")).alias("all_correct_stderr"))


def weighted_sum(df: DataFrame, score: Column, kind: str, weights: Mapping[str, float], scale: float = 1.0) -> DataFrame:
    """One row, (total): the scores of each kind summed, times the kind's weight, over ``scale``; other kinds count nothing."""
    table = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
    return df.agg((F.coalesce(F.sum(score * F.coalesce(table[F.col(kind)], F.lit(0.0))), F.lit(0.0)) / scale).alias("total"))


def circular(df: DataFrame, hit: Column, index: Column, modulus: int = 1_000_000) -> DataFrame:
    """(base, hit): a question counts if all of its rotations, of equal index mod modulus, are hits."""
    return df.groupBy((index % modulus).alias("base")).agg(F.bool_and(hit).alias("hit"))


def group_2x2(df: DataFrame, score: Column, position: Column, by: Column) -> DataFrame:
    """Question, image, plain and group accuracy of groups of 2 questions on 2 images, at positions 0 to 3."""
    bit = lambda k: F.max(F.when(position == k, score))
    g = df.groupBy(by.alias("g")).agg(*(bit(k).alias(f"s{k}") for k in range(4)))
    s = [F.col(f"s{k}") == 1 for k in range(4)]
    q = (s[0] & s[1]).cast("int") + (s[2] & s[3]).cast("int")
    i = (s[0] & s[2]).cast("int") + (s[1] & s[3]).cast("int")
    total = sum((x.cast("int") for x in s[1:]), s[0].cast("int"))
    whole = (s[0] & s[1] & s[2] & s[3]).cast("int")
    return g.agg(F.avg(q / 2).alias("q_acc"), F.avg(i / 2).alias("i_acc"), F.avg(total / 4).alias("acc"), F.avg(whole.cast("double")).alias("g_acc"), F.count("*").alias("groups"))


def outcome_share(df: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, outcome, n, share) with shares within ``by``."""
    counts = df.groupBy(*by, outcome).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def judge_ratio(model: Column, reference: Column, missing: float = -999.0) -> Column:
    """100 * mean(model) / mean(reference), rounded; rows with a missing side are left out."""
    ok = (model != missing) & (reference != missing)
    m, r = F.round(F.avg(F.when(ok, model)), 3), F.round(F.avg(F.when(ok, reference)), 3)
    return F.round(m / r * 100, 1)


def win_rate(winner: Column, model: str, tie: str = "tie") -> Column:
    """Percent of battles won, a tie being half a win; what an Elo fit between two models implies."""
    return F.round(100 * (F.count_if(winner == model) + F.count_if(winner == tie) / 2) / F.count(winner), 2)


def elo_ratings(df: DataFrame, a: str, b: str, winner: str, anchor: str, anchor_rating: float = 1000.0, scale: float = 400.0, rounds: int = 200) -> DataFrame:
    """(model, rating): maximum-likelihood ratings of pairwise battles.

    Battles are counted by pair where they are; the counts, one row for each
    pair of models, are fitted by the minorise-maximise steps of the
    Bradley-Terry model. ``winner`` holds "a", "b" or anything for a tie.
    """
    score = F.when(F.col(winner) == "a", 1.0).when(F.col(winner) == "b", 0.0).otherwise(0.5)
    rows = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.sum(score).alias("won"), F.count("*").alias("n")).collect()
    import math

    models = sorted({r[k] for r in rows for k in ("a", "b")})
    wins, strength = dict.fromkeys(models, 0.0), dict.fromkeys(models, 1.0)
    for r in rows:
        wins[r["a"]] += r["won"]
        wins[r["b"]] += r["n"] - r["won"]
    for _ in range(rounds):
        den = dict.fromkeys(models, 0.0)
        for r in rows:
            share = r["n"] / (strength[r["a"]] + strength[r["b"]])
            den[r["a"]] += share
            den[r["b"]] += share
        strength = {m: max(1e-12, wins[m] / den[m]) if den[m] else 1.0 for m in models}
        mid = math.exp(sum(map(math.log, strength.values())) / len(models))
        strength = {m: s / mid for m, s in strength.items()}
    base = strength.get(anchor, 1.0)
    rated = [(m, anchor_rating + scale * math.log10(s / base)) for m, s in strength.items()]
    return df.sparkSession.createDataFrame(rated, "model string, rating double")


def weighted_fields(scores: Column, weights: Column) -> Column:
    """Weighted mean of the fields that aren't negative; -1 if none is."""
    pairs = F.filter(F.zip_with(scores, weights, lambda s, w: F.struct(s.alias("s"), w.alias("w"))), lambda p: p["s"] >= 0)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["w"])
    return F.when(total == 0, -1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["s"] * p["w"]) / total)


def least_field(scores: Column) -> Column:
    """The smallest field that isn't negative; -1 if none is."""
    return F.coalesce(F.array_min(F.filter(scores, lambda s: s >= 0)), F.lit(-1.0))


# --- corpus scores from additive parts


def precision_parts(pred: Column, golds: Column, order: int = 4) -> Column:
    """For n = 1..order the clipped matches and n-grams of a row, with lengths: sums of these give corpus BLEU.

    ``golds`` is an array of token arrays: an n-gram counts as often as the
    reference that has it most, and the length is that of the reference
    nearest to the prediction's, the shorter on ties.
    """
    from rubrica.functions.text import let, ngrams, numbered

    def parts(p: Column, gs: Column) -> Column:
        def part(n: int) -> Column:
            theirs = F.array_distinct(F.flatten(F.transform(gs, lambda g: numbered(ngrams(g, n)))))
            return F.array(F.size(F.array_intersect(numbered(ngrams(p, n)), theirs)), F.greatest(F.size(p) - (n - 1), F.lit(0)))

        nearest = F.array_min(F.transform(gs, lambda g: F.struct(F.abs(F.size(g) - F.size(p)).alias("off"), F.size(g).alias("n"))))["n"]
        return F.struct(*(part(n).alias(f"n{n}") for n in range(1, order + 1)), F.size(p).alias("pred"), F.coalesce(nearest, F.lit(0)).alias("gold"))

    return let(parts, pred, golds)


@register("bleu")
def bleu_of(parts: Column, order: int = 4) -> Column:
    """Corpus BLEU (0 to 100) from rows' precision_parts."""
    sums = [[F.sum(parts[f"n{i}"][j]).cast("double") for j in (0, 1)] for i in range(1, order + 1)]
    logs = [F.log(hits / grams) for hits, grams in sums]
    none = reduce(lambda x, y: x | y, (F.coalesce(hits, F.lit(0.0)) == 0 for hits, _ in sums))
    pred, gold = F.sum(parts["pred"]), F.sum(parts["gold"])
    brevity = F.when(pred > gold, 1.0).otherwise(F.exp(1 - gold / pred))
    return F.when(none, 0.0).otherwise(100 * brevity * F.exp(reduce(lambda x, y: x + y, logs) / order))


def bleu(df: DataFrame, pred: Column, gold: Column, order: int = 4) -> DataFrame:
    """Corpus BLEU (0 to 100) of token arrays with one reference each; one partial aggregation of counts."""
    return bleus(df, pred, F.array(gold), order).select(F.col(f"bleu_{order}").alias("bleu"))


def bleus(df: DataFrame, pred: Column, golds: Column, order: int = 4) -> DataFrame:
    """bleu_1 to bleu_order, of token arrays with an array of references each."""
    parts = df.select(precision_parts(pred, golds, order).alias("p"))
    return parts.agg(*(bleu_of(F.col("p"), n).alias(f"bleu_{n}") for n in range(1, order + 1)))


def chrf_parts(pred: Column, gold: Column, order: int = 6) -> Column:
    """For n = 1..order the character n-grams shared, predicted and wanted."""
    from rubrica.functions.text import char_ngrams, overlap

    grams = [(char_ngrams(pred, n), char_ngrams(gold, n)) for n in range(1, order + 1)]
    return F.struct(*(F.array(overlap(p, g), F.size(p), F.size(g)).alias(f"n{i}") for i, (p, g) in enumerate(grams, 1)))


@register("chrf")
def chrf_of(parts: Column, order: int = 6, beta: float = 2.0) -> Column:
    """Corpus chrF (0 to 100) from rows' chrf_parts: F with recall weighted by beta, over the orders that have n-grams."""
    b, fs = beta * beta, []
    for i in range(1, order + 1):
        m, p, g = (F.sum(parts[f"n{i}"][j]).cast("double") for j in range(3))
        precision, recall = F.try_divide(m, p), F.try_divide(m, g)
        fs.append(F.coalesce(F.try_divide((1 + b) * precision * recall, b * precision + recall), F.lit(0.0)))
    return 100 * reduce(lambda x, y: x + y, fs) / order


def chrf(df: DataFrame, pred: Column, gold: Column, order: int = 6, beta: float = 2.0) -> DataFrame:
    """Corpus chrF (0 to 100)."""
    return df.select(chrf_parts(pred, gold, order).alias("p")).agg(chrf_of(F.col("p"), order, beta).alias("chrf"))


@register("ter")
def error_rate(distance: Column, length: Column) -> Column:
    """100 * summed distances over summed reference lengths."""
    return 100 * F.sum(distance) / F.sum(length)


def cider(candidates: DataFrame, references: DataFrame, id_col: str = "id", tokens_col: str = "tokens", order: int = 4) -> DataFrame:
    """(id, cider): consensus of n-grams weighted by their rarity over images, relationally.

    ``candidates`` has one row for an id, ``references`` any number. Counts
    are exploded, aggregated and joined, so no text or group is held whole.
    """
    from rubrica.functions.text import ngrams

    def counts(df: DataFrame, extra: list[str]) -> DataFrame:
        of = lambda n: F.transform(ngrams(F.col(tokens_col), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
        grams = F.array(*map(of, range(1, order + 1)))
        rows = df.select(id_col, *extra, F.explode(F.flatten(grams)).alias("x"))
        return rows.groupBy(id_col, *extra, "x.n", "x.g").agg(F.count("*").alias("tf"))

    # written once, so that a reference has one number in all its uses
    refs = staged(references.withColumn("ref", F.monotonically_increasing_id()))
    ref_counts, cand_counts = counts(refs, ["ref"]), counts(candidates, [])
    images = references.agg(F.count_distinct(id_col).cast("double").alias("images"))
    df_ = ref_counts.select(id_col, "n", "g").distinct().groupBy("n", "g").agg(F.count("*").alias("df"))
    idf = df_.join(F.broadcast(images)).select("n", "g", F.log(F.col("images") / F.greatest(F.lit(1.0), F.col("df"))).alias("idf"))
    default = F.log(F.col("images"))
    weigh = lambda c: c.join(idf, ["n", "g"], "left").join(F.broadcast(images)).withColumn("w", F.col("tf") * F.coalesce("idf", default)).drop("idf", "images")
    rw, cw = weigh(ref_counts), weigh(cand_counts)
    rn = rw.groupBy(id_col, "ref", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rnorm"))
    cn = cw.groupBy(id_col, "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("cnorm"))
    dot = rw.join(cw.select(id_col, "n", "g", F.col("w").alias("cw")), [id_col, "n", "g"]).groupBy(id_col, "ref", "n").agg(F.sum(F.least("w", "cw") * F.col("w")).alias("dot"))
    sizes = lambda df, k: df.select(id_col, *k, F.size(tokens_col).alias("len"))
    one = rn.join(cn, [id_col, "n"]).join(dot, [id_col, "ref", "n"], "left")
    one = one.join(sizes(refs, ["ref"]), [id_col, "ref"]).join(sizes(candidates, []).withColumnRenamed("len", "clen"), id_col)
    penalty = F.exp(-F.pow(F.col("clen") - F.col("len"), 2) / F.lit(2 * 36.0))
    value = F.coalesce(F.try_divide(F.col("dot"), F.col("rnorm") * F.col("cnorm")), F.lit(0.0)) * penalty
    n_refs = refs.groupBy(id_col).agg(F.count("*").alias("refs"))
    summed = one.groupBy(id_col).agg(F.sum(value).alias("s"))
    return candidates.select(id_col).join(n_refs, id_col).join(summed, id_col, "left").select(id_col, (10 * F.coalesce("s", F.lit(0.0)) / (order * F.col("refs"))).alias("cider"))


# --- groups of tasks


def closure(members: DataFrame) -> DataFrame:
    """(group, member, depth) of all ancestors, from direct memberships (group, member); depth is the shortest way.

    Ways are joined with each other until no pair is new, so their length
    doubles each time; circles end too, and nothing is its own member.
    """
    found = staged(members.select("group", "member", F.lit(1).alias("depth")).where("group <> member").distinct())
    n = found.count()
    while True:
        on = found.select(F.col("group").alias("member"), F.col("member").alias("beyond"), F.col("depth").alias("more"))
        longer = found.join(on, "member").select("group", F.col("beyond").alias("member"), (F.col("depth") + F.col("more")).alias("depth")).where("group <> member")
        found = staged(found.unionByName(longer).groupBy("group", "member").agg(F.min("depth").alias("depth")))
        before, n = n, found.count()
        if n == before:
            return found


def roll_up(results: DataFrame, members: DataFrame, weighted: bool = True, how: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Group metrics from task metrics (task, metric, filter_key, value, stderr, n).

    The mean is weighted by size or not, or ``how`` makes an aggregate of
    (value, n); the error is pooled; the group's direction is null where its
    members disagree.
    """
    joined = results.join(members.select("group", F.col("member").alias("task")), "task")
    w = F.col("n") if weighted else F.lit(1)
    pooled = F.sqrt(F.sum((F.col("n") - 1) * F.pow("stderr", 2) * F.col("n")) / (F.sum("n") - F.count("*")) / F.sum("n"))
    value = F.sum(F.col("value") * w) / F.sum(w) if how is None else how(F.col("value"), F.col("n"))
    out = [value.alias("value"), pooled.alias("stderr"), F.sum("n").alias("n")]
    if "higher_is_better" in results.columns:
        out.append(F.when(F.min("higher_is_better") == F.max("higher_is_better"), F.max("higher_is_better")).alias("higher_is_better"))
    return joined.groupBy("group", "metric", "filter_key").agg(*out)


# --- resampling


def _uniform(*keys: Column | str) -> Column:
    """In (0, 1), by a hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11) + 0.5) * F.lit(2.0**-53)


def poisson(mean: Column, *keys: Column | str) -> Column:
    """A Poisson count by a hash of the keys: by its cumulative probabilities up to a mean of 50, beyond by the normal law."""
    u = _uniform(F.lit(1), *keys)
    step = lambda a, k: F.when(a["left"] <= 0, a).otherwise(F.struct((a["left"] - a["p"] * mean / k).alias("left"), (a["p"] * mean / k).alias("p"), k.cast("double").alias("k")))
    start = F.struct((u - F.exp(-mean)).alias("left"), F.exp(-mean).alias("p"), F.lit(0.0).alias("k"))
    exact = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step)["k"]
    normal = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * _uniform(F.lit(2), *keys))
    return F.when(mean <= 50, exact).otherwise(F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * normal)))


def bootstrap(df: DataFrame, value: Column, by: Sequence[str] = (), resamples: int = 1000, seed: int = 1234) -> DataFrame:
    """(by, mean, stderr, low, high): error and 95 % interval of a mean.

    Poisson resampling of the counts of equal values: a value that n rows have
    weighs Poisson(n) in a resample, as n rows that weigh Poisson(1) each would.
    So it is different values, not rows, that are multiplied by the resamples.
    """
    counts = df.select(*by, value.cast("double").alias("v")).where("v is not null").groupBy(*by, "v").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*by).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    each = counts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", poisson(F.col("n").cast("double"), F.lit(seed), "v", "b", *by))
    means = each.groupBy(*by, "b").agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum("w")).alias("m"))
    spread = means.groupBy(*by).agg(F.stddev_samp("m").alias("stderr"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"))
    # broadcast: one row where there are no groups
    joined = sums.join(spread, list(by)) if by else sums.join(F.broadcast(spread))
    return joined.select(*by, "mean", "stderr", F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"))
