"""The corpus pipeline over the core operators, and its command line.

Stages: filter by lexicon, exact and near duplicates, sample, split; tag and annotate; validate and evaluate; write and
read back. One lazy plan from the source to the split, written once; every later stage reads that table.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions.session import cut
from corpuskit.operators import dedup, filters, metrics, reports, sampling, taggers, validate
from corpuskit.sources import files

log = logging.getLogger("corpuskit")


@dataclass
class Settings:
    """Lexicons and sizes; the defaults of sizes are those of a corpus of 50 000."""

    lexicon: tuple[str, ...] = ()
    rajasthani: tuple[str, ...] = ()
    english: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    entities: tuple = ()
    least_tokens: int = 2
    percent: int = 85
    sample: int = 50_000
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)
    seed: int = 42
    targets: dict[str, float] = field(default_factory=lambda: {"sentiment": 0.85, "ner": 0.82, "toxicity": 0.79})


def build(raw: DataFrame, s: Settings) -> DataFrame:
    """Raw records (seq, sentence_id, text, ...) filtered, without duplicates, sampled if there are enough, and split."""
    kept = filters.lexicon_filter(raw, s.lexicon, s.least_tokens) if s.lexicon else raw
    kept = cut(dedup.exact_dedup(kept))
    kept = cut(dedup.greedy_keep(kept, percent=s.percent))
    return cut(sampling.stratified_split(sampling.sample_or_all(kept, s.sample, seed=s.seed), s.ratios, seed=s.seed))


def annotate(split: DataFrame, s: Settings) -> DataFrame:
    """The split records with placeholder annotations and language tags."""
    return taggers.as_annotated(split, "train", s.rajasthani, s.english).drop("split").join(split.select("sentence_id", "split"), "sentence_id")


def evaluate(annotated: DataFrame, s: Settings) -> DataFrame:
    """(task, macro_f1) of the lexicon models on the test split; without one on the first tenth."""
    test = filters.split_or_start(annotated, "test", "sentence_id")
    test = test.withColumns({"_s": taggers.sentiment("text", s.positive, s.negative)["label"], "_t": taggers.toxicity("text", s.keywords)["labels"] if s.keywords else F.array().cast("array<string>"), "_n": taggers.entities("text", s.entities)})
    parts = {"sentiment": metrics.single_label(test, "sentiment", "_s"), "toxicity": metrics.multi_label(test, "toxicity_labels", "_t"), "ner": metrics.spans(test, "ner_spans", "_n")}
    out = [metrics.macro(m).select(F.lit(t).alias("task"), "macro_f1") for t, m in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def run(spark: SparkSession, raw: DataFrame, out: str, s: Settings = Settings()) -> dict[str, DataFrame]:
    """All stages; files ``out``/corpus.jsonl and ``out``/corpus.parquet. Errors of validators are reported, a record that
    does not come back from the JSON lines as it was is fatal."""
    split = build(raw, s)
    log.info("split: %s", {r.split: r["count"] for r in split.groupBy("split").count().collect()})
    annotated = cut(annotate(split, s))
    errors = validate.span_errors(annotated).select("sentence_id", F.col("message")).unionByName(validate.category_errors(annotated).select("sentence_id", F.concat_ws(" ", "error", F.array_join("labels", ",")).alias("message")))
    scores = cut(evaluate(annotated, s))
    files.write_annotated(annotated, f"{out}/corpus.jsonl")
    files.write_annotated(annotated, f"{out}/corpus.parquet", "parquet", by_split=True)
    validate.assert_round_trip(files.read_annotated_like(annotated), files.read_annotated(spark, f"{out}/corpus.jsonl"))
    table = reports.comparison(reports.stub_results(spark).unionByName(scores.select(F.lit(99).alias("seq"), F.lit("lexicon").alias("model_name"), "task", "macro_f1")), [*reports.STUBS, "lexicon"])
    return {"annotated": annotated, "errors": errors, "scores": scores, "gate": filters.release_gate(scores, s.targets), "table": table, "statistics": reports.corpus_statistics(annotated)}


def source(spark: SparkSession, path: str, platform: str = "other") -> DataFrame:
    """Manual records by the file's ending: .csv, .json, .txt or .jsonl."""
    readers = {"csv": files.read_csv, "json": files.read_json, "txt": lambda sp, p: files.read_text(sp, p, platform), "jsonl": files.read_raw}
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in readers:
        raise ValueError(f"unsupported file {path}; it must end in {', '.join('.' + r for r in readers)}")
    return readers[ending](spark, path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m corpuskit.plans.pipeline", description="Build a corpus from a file of records.")
    p.add_argument("source", help="a .csv, .json, .txt or .jsonl file")
    p.add_argument("out", help="folder of the results")
    p.add_argument("--lexicon", help="file of words; records need two of them")
    p.add_argument("--sample", type=int, default=50_000)
    p.add_argument("--seed", type=int, default=42)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("corpuskit").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    words = tuple(r.word for r in files.read_lexicon(spark, a.lexicon).limit(filters.INLINE + 1).collect()) if a.lexicon else ()
    if len(words) > filters.INLINE:
        p.error(f"lexicons of over {filters.INLINE} words are given to filters.lexicon_filter as a frame")
    got = run(spark, source(spark, a.source), a.out, Settings(lexicon=words, sample=a.sample, seed=a.seed))
    print(reports.comparison_text(got["table"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
