"""Reports: comparison tables, platform splits, corpus statistics, prompts and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions.labels import TASKS
from corpuskit.functions.text import platform_of, tokens

#: What stub baselines report, model by task; constants, not measurements.
STUBS = {"mBERT zero-shot": {"sentiment": 0.45, "ner": 0.38, "toxicity": 0.32}, "MuRIL zero-shot": {"sentiment": 0.52, "ner": 0.44, "toxicity": 0.38}, "GPT-4o 5-shot": {"sentiment": 0.62, "ner": 0.58, "toxicity": 0.51}}


def stub_results(spark, seq: int = 0) -> DataFrame:
    """(seq, model_name, task, macro_f1) of the constants."""
    rows = [(seq + 3 * i + j, m, t, f) for i, (m, s) in enumerate(STUBS.items()) for j, (t, f) in enumerate(s.items())]
    return spark.createDataFrame(rows, "seq int, model_name string, task string, macro_f1 double")


def proportions(df: DataFrame, by: str = "platform") -> DataFrame:
    """(by, n, share): one row a value."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def comparison(results: DataFrame, required: list[str]) -> DataFrame:
    """(place, model_name, sentiment, ner, toxicity): ``results`` (seq, model_name, task, macro_f1) with the last result of
    a model and task; the required models first, there even without results, then the others as they came; missing figures
    are NaN."""
    own = results.groupBy("model_name").pivot("task", list(TASKS)).agg(F.max_by("macro_f1", "seq"))
    came = results.groupBy("model_name").agg(F.min("seq").alias("came"))
    need = results.sparkSession.createDataFrame(list(enumerate(required)), "ord int, model_name string")
    j = need.join(own.join(came, "model_name"), "model_name", "full")
    place = F.row_number().over(Window.orderBy(F.col("ord").isNull(), "ord", "came", "model_name"))
    return j.select(place.alias("place"), "model_name", *(F.coalesce(F.col(t), F.lit(float("nan"))).alias(t) for t in TASKS))


def comparison_text(table: DataFrame) -> str:
    """The table as Markdown, four decimals, N/A for missing figures; one row a model reaches the driver."""
    rows = table.orderBy("place").collect()
    if not rows:
        return "(no results)"
    show = lambda x: "N/A" if x != x else f"{x:.4f}"
    cells = [("Model", "Sentiment F1", "NER F1", "Toxicity F1"), *((r.model_name, *(show(r[t]) for t in TASKS)) for r in rows)]
    wide = [max(len(c[i]) for c in cells) for i in range(4)]
    line = lambda c: "| " + " | ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(c, wide))) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, cells[1:])])


def platform_split(scores: DataFrame, platforms: tuple[str, ...] = ("twitter", "sharechat")) -> DataFrame:
    """(task, train_platform, eval_platform, macro_f1): lexicon models learn nothing from training, so the figure of a
    direction is that of its evaluation platform; ``scores`` has task, platform, macro_f1; no records give 0."""
    p = scores.sparkSession.createDataFrame([(t, a, b) for t in TASKS for a in platforms for b in platforms if a != b], "task string, train_platform string, eval_platform string")
    s = scores.select("task", F.col("platform").alias("eval_platform"), "macro_f1")
    return p.join(s, ["task", "eval_platform"], "left").select("task", "train_platform", "eval_platform", F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def ablation(without: DataFrame, with_: DataFrame, gain: float = 0.04) -> DataFrame:
    """(without_f1, with_f1, improvement, meets) of two one-row frames with macro_f1."""
    j = without.select(F.col("macro_f1").alias("without_f1")).crossJoin(with_.select(F.col("macro_f1").alias("with_f1")))
    d = F.col("with_f1") - F.col("without_f1")
    return j.select("without_f1", "with_f1", d.alias("improvement"), (d >= gain).alias("meets"))


def corpus_statistics(df: DataFrame) -> DataFrame:
    """(split, platform, records, tokens, with_entity, toxic, positive, neutral, negative) with totals over each; a total's
    key is ``all``."""
    d = df.select(F.coalesce("split", F.lit("none")).alias("split"), F.coalesce(platform_of(), F.lit("none")).alias("platform"), F.coalesce(F.size(tokens("text")), F.lit(0)).alias("t"), (F.coalesce(F.size("ner_spans"), F.lit(0)) > 0).alias("e"), (F.coalesce(F.size("toxicity_labels"), F.lit(0)) > 0).alias("x"), "sentiment")
    g = d.cube("split", "platform").agg(F.count("*").alias("records"), F.sum("t").alias("tokens"), F.count_if("e").alias("with_entity"), F.count_if("x").alias("toxic"), *(F.count_if(F.col("sentiment") == s).alias(s) for s in ("positive", "neutral", "negative")))
    return g.withColumns({"split": F.coalesce("split", F.lit("all")), "platform": F.coalesce("platform", F.lit("all"))})


def entity_statistics(df: DataFrame) -> DataFrame:
    """(split, entity_type, n) of gold spans."""
    return df.select("split", F.explode("ner_spans").alias("p")).groupBy("split", F.col("p.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


def language_statistics(df: DataFrame) -> DataFrame:
    """(split, label, n) of token labels."""
    return df.select("split", F.explode("token_language_labels").alias("t")).groupBy("split", F.col("t.label").alias("label")).agg(F.count("*").alias("n"))


#: The wording of the prompts.
HEADS = {
    "sentiment": ("Classify the sentiment of the following Rajasthani-Hindi sentence.\nLabels: positive, neutral, negative.\n", "Sentiment"),
    "ner": ("Identify named entities (PER, LOC, ORG) in the following Rajasthani-Hindi sentence.\n", "Entities"),
    "toxicity": ("Classify the toxicity of the following Rajasthani-Hindi sentence.\nCategories (select all that apply): caste_slur, religious, gender, general.\nIf none apply, output: none.\n", "Toxicity"),
}
SHOTS = 5


def _answer(task: str) -> Column:
    if task == "sentiment":
        return F.col("sentiment")
    parts = F.transform("ner_spans", lambda p: F.concat(p["text"], F.lit(" ("), p["entity_type"], F.lit(")"))) if task == "ner" else F.col("toxicity_labels")
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("none"))


def prompts(df: DataFrame, examples: DataFrame, task: str, order: str = "sentence_id") -> DataFrame:
    """(sentence_id, prompt): up to five examples, the first by ``order``, then the sentence. The examples' part is one
    small row, joined to all."""
    head, name = HEADS[task]
    shots = examples.orderBy(order).limit(SHOTS).select(F.col(order).alias("_o"), F.concat(F.lit("  Sentence: "), F.col("text"), F.lit(f"\n  {name}: "), _answer(task), F.lit("\n")).alias("_t"))
    part = shots.agg(F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_s"))
    shown = F.array_join(F.transform("_s", lambda s, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), s["_t"])), "\n")
    j = df.crossJoin(F.broadcast(part))
    text = F.concat(F.lit(head), F.lit("\n"), shown, F.when(F.size("_s") > 0, "\n").otherwise(""), F.lit("Sentence: "), F.col("text"), F.lit(f"\n{name}:"))
    return j.select("sentence_id", text.alias("prompt"))


def dataset_card(name: str, statistics: DataFrame, notes: str = "") -> str:
    """A dataset card in Markdown from ``corpus_statistics`` (its totals over platforms)."""
    rows = sorted(statistics.where("platform = 'all'").collect(), key=lambda r: r.split)
    body = "\n".join(f"| {r.split} | {r.records} | {r.tokens} | {r.toxic} |" for r in rows)
    return f"# {name}\n\n{notes}\n\n| split | records | tokens | toxic |\n|---|---|---|---|\n{body}\n"


def model_card(name: str, gate: DataFrame, notes: str = "") -> str:
    """A model card in Markdown from ``filters.release_gate``."""
    show = lambda x: "N/A" if x is None or x != x else f"{x:.4f}"
    body = "\n".join(f"| {r.task} | {show(r.actual)} | {r.target:.2f} | {'yes' if r.passed else 'no'} |" for r in gate.orderBy("task").collect())
    return f"# {name}\n\n{notes}\n\n| task | macro F1 | target | met |\n|---|---|---|---|\n{body}\n"
