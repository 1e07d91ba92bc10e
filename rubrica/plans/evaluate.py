"""From documents and responses to results: task specifications and the evaluation plan.

docs -> instances -> responses -> filtered -> items -> results -> groups, all
lazy; only results are small. A metric makes items of a row, one column or
several, and an aggregation makes one value of all rows' items.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions import filters, template
from rubrica.functions import text as T
from rubrica.operators import metrics


@dataclass(frozen=True)
class Metric:
    """One entry of a task's metric list.

    ``aggregation`` is a registered name or a function of the metric's item
    columns to an aggregate; without one it is the metric's own. Everything
    else of the entry is passed to what scores a response.
    """

    name: str
    aggregation: str | Callable[..., Column] | None = None
    higher_is_better: bool | None = None
    settings: Mapping[str, object] = field(default_factory=dict)

    def aggregate(self, items: Sequence[Column]) -> Column:
        how = self.aggregation or metrics.METRICS.get(self.name, ("mean", True))[0]
        return (metrics.AGGREGATIONS[how] if isinstance(how, str) else how)(*items)

    def is_mean(self) -> bool:
        return (self.aggregation or metrics.METRICS.get(self.name, ("mean", True))[0]) == "mean"

    def better(self) -> bool:
        return metrics.METRICS.get(self.name, ("mean", True))[1] if self.higher_is_better is None else self.higher_is_better


@dataclass(frozen=True)
class Task:
    name: str
    output_type: str = "generate_until"
    doc_to_text: str | int = ""
    doc_to_target: str | int = ""
    doc_to_choice: str | Sequence[str] | None = None
    #: Number of shots, how they are chosen ("random" or "first_n"), and what joins them.
    fewshot: int = 0
    sampler: str = "random"
    description: str = ""
    target_delimiter: str = " "
    fewshot_delimiter: str = "\n\n"
    repeats: int = 1
    filters: Mapping[str, Sequence] = field(default_factory=lambda: {"none": ["take_first"]})
    #: Entries as Metric, by name, or as a task file has them; none: those of the output type.
    metrics: Sequence[Metric | str | Mapping] = ()
    #: metric -> (response column, target column) -> score, averaged; besides ``metrics``.
    scores: Mapping[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    #: A map over documents, before anything else.
    process_docs: Callable[[DataFrame], DataFrame] | None = None
    #: (row columns) -> {metric: item columns}, instead of the scorers; columns are those of joined().
    process_results: Callable[[Callable[[str], Column]], Mapping[str, Column | Sequence[Column]]] | None = None
    version: str = "0"

    def metric_list(self) -> list[Metric]:
        given = [m if isinstance(m, Metric) else Metric(m) if isinstance(m, str) else Metric(m["metric"], m.get("aggregation"), m.get("higher_is_better"), {k: v for k, v in m.items() if k not in ("metric", "aggregation", "higher_is_better")}) for m in self.metrics]
        return given or ([] if self.scores else [Metric(m) for m in metrics.DEFAULTS[self.output_type]])


def load_yaml(path: str, functions: Mapping[str, Callable] | None = None) -> dict:
    """A task file with its ``include`` parents merged, the child over them; ``!function name`` is looked up in ``functions``."""

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!function", lambda loader, node: (functions or {}).get(loader.construct_scalar(node), loader.construct_scalar(node)))
    with open(path, encoding="utf-8") as f:
        own = yaml.load(f, Loader) or {}
    parents = own.pop("include", [])
    merged: dict = {}
    for p in reversed([parents] if isinstance(parents, str) else parents):
        merged |= load_yaml(os.path.join(os.path.dirname(path), p), functions)
    return merged | own


def task_index(folder: str) -> list[tuple[str, str, str]]:
    """(name, kind, path) of all task, group and tag files under a folder."""
    out = []
    for base, _, names in os.walk(folder):
        for n in sorted(names):
            if n.endswith((".yaml", ".yml")):
                d = load_yaml(os.path.join(base, n))
                if "group" in d and isinstance(d.get("task"), list):
                    out.append((d["group"], "group", os.path.join(base, n)))
                elif isinstance(d.get("task"), str):
                    out.append((d["task"], "task", os.path.join(base, n)))
                    out += [(t, "tag", os.path.join(base, n)) for t in ([d["tag"]] if isinstance(d.get("tag"), str) else d.get("tag") or [])]
    return sorted(out)


#: Names of a task file's entries, where they differ from Task's.
_ALIASES = {"num_fewshot": "fewshot", "metric_list": "metrics", "fewshot_sampler": "sampler"}


def task_from(config: Mapping) -> Task:
    known = {f.name for f in fields(Task)}
    named = {_ALIASES.get(k, k): v for k, v in config.items()}
    settings = named.pop("fewshot_config", None) or {}
    if "sampler" in settings:
        named.setdefault("sampler", settings["sampler"])
    return Task(name=config["task"], **{k: v for k, v in named.items() if k in known and k != "name" and v is not None})


def parse_arguments(text: str) -> dict[str, bool | int | float | str]:
    """Settings written as name=value,name=value; values become booleans or numbers where they read as such."""

    def value(v: str) -> bool | int | float | str:
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    pairs = (p.partition("=") for p in text.strip().split(",") if p)
    return {name: value(v) for name, _, v in pairs}


def settings_for(model: str, settings: Mapping[str, object] | None) -> dict:
    """A task's settings for one model: its own, else the default ones over those common to all."""
    settings = dict(settings or {})
    if model in settings:
        return dict(settings[model])
    common = {k: v for k, v in settings.items() if not isinstance(v, Mapping)}
    return common | dict(settings.get("default") or settings.get("dataset") or {})


def _choices(task: Task, columns: list[str]) -> Column:
    c = task.doc_to_choice
    return F.array(*(template.render(x) for x in c)) if not isinstance(c, str) else F.col(c) if c in columns else template.expression(c.strip("{} "))


def _target_text(task: Task, columns: list[str]) -> Column:
    """What a shot shows as its answer: the first of several targets, or the choice that a number names."""
    target = template.resolve(task.doc_to_target, columns)
    if task.doc_to_target in columns or isinstance(task.doc_to_target, int):
        if task.doc_to_choice is not None:
            return F.coalesce(F.get(_choices(task, columns), target.try_cast("int")), target.cast("string"))
    return target.cast("string")


def fewshot_prompts(docs: DataFrame, shots: DataFrame, prompt: Column, separator: str = "\n\n", description: str = "") -> DataFrame:
    """Documents with ``context``: the description, the shots' texts (doc_id, shots array of text) and the document's own prompt."""
    shown = F.when(F.size("shots") > 0, F.concat(F.array_join("shots", separator), F.lit(separator))).otherwise("")
    return docs.join(shots, "doc_id", "left").withColumn("context", F.concat(template.render(description), F.coalesce(shown, F.lit("")), prompt))


def shots_of(docs: DataFrame, pool: DataFrame, task: Task, seed: int = 1234) -> DataFrame:
    """(doc_id, shots): the texts of a document's shots, prompts with their answers."""
    from rubrica.operators import selection

    text = F.concat(template.resolve(task.doc_to_text, pool.columns).cast("string"), F.lit(task.target_delimiter), _target_text(task, pool.columns))
    shown = pool.select("doc_id", text.alias("shot"))
    if task.sampler == "first_n":
        first = selection.fewshot_first(shown, task.fewshot).agg(F.array_sort(F.collect_list(F.struct("doc_id", "shot")))["shot"].alias("shots"))
        # broadcast: one row with the task's shots
        return docs.select("doc_id").join(F.broadcast(first))
    drawn = selection.fewshot_random(docs.select("doc_id"), shown, task.fewshot, seed)
    return drawn.select("doc_id", F.transform("shots", lambda x: x["shot"]).alias("shots"))


def instances(docs: DataFrame, task: Task, mutual_info: bool = False, pool: DataFrame | None = None) -> DataFrame:
    """One request for each document and repeat, or for each of its choices; with mutual information, unconditional ones too.

    Prompts begin with the description and the shots, drawn from ``pool`` (by
    default the documents).
    """
    if task.process_docs is not None:
        docs = task.process_docs(docs)
    prompt, target = template.resolve(task.doc_to_text, docs.columns).cast("string"), template.resolve(task.doc_to_target, docs.columns).cast("string")
    if task.fewshot:
        docs = fewshot_prompts(docs, shots_of(docs, docs if pool is None else pool, task), prompt, task.fewshot_delimiter, task.description)
        prompt = F.col("context")
    elif task.description:
        prompt = F.concat(template.render(task.description), prompt)
    base = docs.select(F.lit(task.name).alias("task"), "doc_id", prompt.alias("prompt"), target.alias("target"), F.lit(task.output_type).alias("request_type"), *([_choices(task, docs.columns).alias("_c")] if task.doc_to_choice is not None else []))
    base = base.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(task.repeats - 1)))) if task.repeats > 1 else base.withColumn("repeat", F.lit(0))
    if task.output_type != "multiple_choice":
        return base.withColumn("idx", F.lit(0)).withColumn("continuation", F.lit(None).cast("string") if task.output_type.startswith("generate") else F.col("target")).drop("_c")
    each = base.select(*(c for c in base.columns if c != "_c"), F.posexplode("_c").alias("idx", "continuation"))
    if mutual_info:
        each = each.unionByName(each.withColumn("prompt", F.lit("")).withColumn("request_type", F.lit("unconditional")))
    return each


def gathered(responses: DataFrame) -> DataFrame:
    """(task, doc_id, resps): the responses of a document in order of choice and repeat."""
    g = responses.groupBy("task", "doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "repeat", "resp"))).alias("r"))
    return g.select("task", "doc_id", F.col("r.resp").alias("resps"))


def multiple_choice_scores(losses: Column, choices: Column, gold: Column, unconditional: Column | None = None) -> dict[str, Column]:
    """acc, acc_norm and, with unconditional losses, acc_mutual_info: smallest loss, by character, by gain; first on ties."""
    first_min = lambda a: (F.array_position(a, F.array_min(a)) - 1).cast("int")
    by_char = F.zip_with(losses, choices, lambda x, c: x / F.length(c))
    out = {"acc": (first_min(losses) == gold).cast("double"), "acc_norm": (first_min(by_char) == gold).cast("double")}
    if unconditional is not None:
        gain = F.zip_with(losses, unconditional, lambda x, u: x - u)
        out["acc_mutual_info"] = (first_min(gain) == gold).cast("double")
    return out


#: Classes that the F1 and MCC of multiple choice tell apart.
CLASSES = 26


def _choice_items(column: Callable[[str], Column], wanted: Sequence[str]) -> dict[str, Sequence[Column]]:
    """Items of multiple choice, from losses, greedy, choices and gold (the right choice's number, or several)."""
    losses, golds = column("losses"), column("golds")
    pred = (F.array_position(losses, F.array_min(losses)) - 1).cast("int")
    scores = multiple_choice_scores(losses, column("choices"), F.get(golds, F.lit(0)), column("unconditional") if "acc_mutual_info" in wanted else None)
    if "acc_norm" in wanted:
        by_char = F.zip_with(losses, column("choices"), lambda x, c: x / F.length(c))
        scores["acc_norm"] = F.array_contains(golds, (F.array_position(by_char, F.array_min(by_char)) - 1).cast("int")).cast("double")
    greedy = F.exists(golds, lambda g: F.coalesce(F.get(column("greedy"), g), F.lit(False)))
    first = F.get(golds, F.lit(0))
    many = F.when((pred >= CLASSES) | (first >= CLASSES), F.raise_error(F.lit(f"more than {CLASSES} choices")).cast("int")).otherwise(pred)
    return {
        "acc": [F.array_contains(golds, pred).cast("double")],
        "acc_norm": [scores["acc_norm"]],
        "exact_match": [greedy.cast("double")],
        "f1": [first == 1, pred == 1],
        "mcc": [first, many],
        **({"acc_mutual_info": [scores["acc_mutual_info"]]} if "acc_mutual_info" in scores else {}),
    }


def _text_items(metric: Metric, pred: Column, golds: Column) -> Sequence[Column]:
    """Items of a generated answer: the best over the targets where a metric is yes or no."""
    how = dict(metric.settings)
    words = lambda c: T.tokens(c)
    match metric.name:
        case "exact_match" | "acc":
            flags = {k: bool(how.get(k)) for k in ("ignore_case", "ignore_punctuation", "ignore_numbers")}
            return [T.any_match(lambda g: T.exact_match(pred, T.strip(g), ignore=how.get("regexes_to_ignore") or (), **flags), golds)]
        case "anls":
            return [T.anls(pred, golds, float(how.get("threshold", 0.5)))]
        case "f1" | "mcc":
            return [T.exact_match(F.get(golds, F.lit(0)), F.lit("1")) == 1, T.exact_match(pred, F.lit("1")) == 1]
        case "bleu":
            return [metrics.precision_parts(words(pred), F.transform(golds, words))]
        case "chrf":
            return [metrics.chrf_parts(pred, F.get(golds, F.lit(0)))]
        case "ter":
            return [T.token_distance(words(pred), words(F.get(golds, F.lit(0)))), F.size(words(F.get(golds, F.lit(0))))]
        case "bypass":
            return [F.lit(None).cast("double")]
    raise ValueError(f"no scorer for {metric.name!r} of generated answers; give process_results or scores")


def _likelihood_items(column: Callable[[str], Column], rolling: bool) -> dict[str, Sequence[Column]]:
    """Items of one loglikelihood: of the whole text with its words and bytes if rolling."""
    ll, text = column("ll"), column("target")
    if rolling:
        size, n_words = F.octet_length(text).cast("double"), F.size(T.tokens(text)).cast("double")
        return {"word_perplexity": [ll, n_words], "byte_perplexity": [ll, size], "bits_per_byte": [ll, size]}
    return {"perplexity": [ll], "acc": [column("greedy").cast("double")]}


def joined(docs: DataFrame, responses: DataFrame, task: Task) -> DataFrame:
    """The documents with their responses, one row for each document and filter.

    Generated: resps and filter_key, resp. Multiple choice: losses, greedy and,
    of unconditional requests, unconditional, by choice. Loglikelihoods: ll,
    greedy. Besides: target, golds, choices.
    """
    columns = docs.columns
    target = template.resolve(task.doc_to_target, columns)
    made = {"target": target.cast("string")}
    kind = dict(docs.dtypes).get(str(task.doc_to_target), "string")
    if task.doc_to_choice is not None:
        made["choices"] = _choices(task, columns)
        number = lambda t: t.cast("int") if kind in ("int", "bigint", "smallint", "array<int>", "array<bigint>") or isinstance(task.doc_to_target, int) else (F.array_position(made["choices"], t) - 1).cast("int")
        golds = F.transform(target, number) if kind.startswith("array") else F.array(number(target))
        # an index that no choice has is never right
        made["golds"] = F.transform(golds, lambda g: F.when((g >= 0) & (g < F.size(made["choices"])), g).otherwise(-100))
        if task.output_type != "multiple_choice":
            made["golds"] = F.transform(made["golds"], lambda g: F.get(made["choices"], g))
    elif not task.output_type.startswith("loglikelihood"):
        made["golds"] = target.cast("array<string>") if kind.startswith("array") else F.array(target.cast("string"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), *(c.alias(k) for k, c in made.items()))
    own = responses.where(F.col("task") == task.name)
    if task.output_type == "multiple_choice":
        conditional = F.coalesce(F.col("conditional"), F.lit(True)) if "conditional" in own.columns else F.lit(True)
        gather = lambda c, only: F.array_sort(F.collect_list(F.when(only, F.struct("idx", F.col(c).alias("v")))))["v"]
        # one row for each choice
        g = own.groupBy("doc_id").agg(gather("loss", conditional).alias("losses"), (gather("greedy", conditional) if "greedy" in own.columns else F.array().cast("array<boolean>")).alias("greedy"), gather("loss", ~conditional).alias("unconditional"))
        return rows.join(g, "doc_id").withColumn("filter_key", F.lit("none"))
    if task.output_type.startswith("loglikelihood"):
        g = own.select("doc_id", "ll", *(["greedy"] if "greedy" in own.columns else []))
        return rows.join(g, "doc_id").withColumn("filter_key", F.lit("none"))
    g = filters.apply_pipelines(gathered(own), task.filters).drop("task")
    return rows.join(g, "doc_id")


def evaluate(docs: DataFrame, responses: DataFrame, task: Task, limit: float | None = None) -> DataFrame:
    """(task, metric, filter_key, value, stderr, n, n_shot, version, higher_is_better): results of one task.

    ``docs`` has doc_id and the task's columns. ``responses`` has (task, doc_id,
    idx, repeat, resp) of generated answers, (task, doc_id, idx, loss) of
    choices, with greedy and conditional if known, or (task, doc_id, ll) of
    loglikelihoods. One join and one scan make all metrics; each is aggregated
    as its list entry says, partially before the shuffle. Means have an error.
    """
    from rubrica.operators.selection import limit_docs

    docs = limit_docs(docs, limit)
    if task.process_docs is not None:
        docs = task.process_docs(docs)
    rows, listed = joined(docs, responses, task), task.metric_list()
    column = F.col
    if task.process_results is not None:
        found = task.process_results(column)
        items = {m: [c] if isinstance(c, Column) else list(c) for m, c in found.items()}
    elif task.output_type == "multiple_choice":
        items = _choice_items(column, [m.name for m in listed])
    elif task.output_type.startswith("loglikelihood"):
        items = _likelihood_items(column, task.output_type == "loglikelihood_rolling")
    else:
        resp = T.strip(F.get("resp", F.lit(0)))
        items = {m.name: _text_items(m, resp, column("golds")) for m in listed}
    items |= {m: [f(F.get("resp", F.lit(0)), column("target")).cast("double")] for m, f in task.scores.items()}
    listed = listed + [Metric(m) for m in task.scores] if task.process_results is None else listed or [Metric(m) for m in items]
    missing = [m.name for m in listed if m.name not in items]
    if missing:
        raise ValueError(f"no scores for {missing}")
    flat = rows.select("filter_key", *(c.alias(f"{i}_{j}") for i, m in enumerate(listed) for j, c in enumerate(items[m.name])))
    aggregates = []
    for i, m in enumerate(listed):
        own = [F.col(f"{i}_{j}") for j in range(len(items[m.name]))]
        value = metrics.matthews_classes(*own, CLASSES) if m.name == "mcc" and task.output_type == "multiple_choice" and m.aggregation is None else m.aggregate(own)
        error = metrics.stderr(own[0]) if m.is_mean() else F.lit(None).cast("double")
        n = F.count(own[0]) if m.is_mean() else F.count("*")
        aggregates.append(F.struct(F.lit(m.name).alias("metric"), value.cast("double").alias("value"), error.alias("stderr"), n.alias("n"), F.lit(m.better()).alias("higher_is_better")))
    # one aggregate each, so that every metric combines in the one pass
    done = flat.groupBy("filter_key").agg(*(a.alias(f"m{i}") for i, a in enumerate(aggregates)))
    out = done.select("filter_key", F.explode(F.array(*(f"m{i}" for i in range(len(aggregates))))).alias("x"))
    return out.select(F.lit(task.name).alias("task"), "x.metric", "filter_key", "x.value", "x.stderr", "x.n", F.lit(task.fewshot).alias("n_shot"), F.lit(task.version).alias("version"), "x.higher_is_better")


# --- judges


def judge_prompts(rows: DataFrame, text: str) -> DataFrame:
    """Rows with ``judge_prompt``, by a template."""
    return rows.withColumn("judge_prompt", template.render(text))


def judged(requests: DataFrame, answers: DataFrame, parser: Callable[[Column], Column], key: str = "request_id") -> DataFrame:
    """Requests with ``score`` from the judge's recorded answers (key, judge_response); null where there is none."""
    return requests.join(answers.select(key, "judge_response"), key, "left").withColumn("score", parser(F.col("judge_response")))


PROVIDERS: dict[str, Callable[[list[str]], list[str]]] = {"dummy": lambda prompts: ["1"] * len(prompts)}


def ask(requests: DataFrame, provider: str = "dummy", batch: int = 64, prompt: str = "judge_prompt", at_once: int = 4) -> DataFrame:
    """Adds ``judge_response`` by a registered provider, in bounded batches on the executors, of which each task has ``at_once`` under way."""
    call = PROVIDERS[provider]

    def run(frames):
        with ThreadPoolExecutor(at_once) as pool:
            for f in frames:
                batches = [list(f[prompt].iloc[i : i + batch]) for i in range(0, len(f), batch)]
                yield f.assign(judge_response=[a for answers in pool.map(call, batches) for a in answers])

    kinds = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    return requests.mapInPandas(run, f"{kinds}, judge_response string")
