"""Whole training sets: samples drawn, split, answered, checked and written, with their figures.

A job's steps are tables of one folder. A step whose table is complete has a marker, written last; a run redoes the steps
without one, so a job that was stopped goes on. What is drawn is bounded by the targets that the caller names; everything
before the draw is counted and ordered in parallel, top-n by top-n, and no stratum is held by a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reports as P
from ..operators import datasets as B
from ..operators import shaping as O
from ..sources import writers
from ..streaming.pointer import Pointer

#: Share of each layer of styles among training samples, the names of the splits, and events of a report's round.
LAYERS = {"rich": 0.5, "medium": 0.35, "poor": 0.15}
SPLITS = ("train", "val", "test")
ROUND = 60
#: Signs of which a report has one at least, and interfaces of which two calls make a chain.
ICONS = ["🧵", "👔", "🚚", "🔴", "🟡", "🟢"]
CHAINED = ["kg_query", "rag_query"]
_TURN = "function_calls array<struct<name:string,params:map<string,string>,result:string>>"


class Job:
    """Named steps in a folder of the shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.marks = spark, path, Pointer(spark, path)
        self.redone: list[str] = []

    def step(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The step's table, made and written unless an earlier run completed it."""
        if name not in self.marks.read_all():
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.marks.write_named(name, {})
            self.redone.append(name)
        return self.spark.read.parquet(f"{self.path}/{name}")


def _first(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(B.rank_key(F.col(key), seed), key).limit(n)


def _numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows, no more than a target, numbered from 0 in seeded order."""
    return rows.withColumn("draw", F.row_number().over(Window.orderBy(B.rank_key(F.col(key), seed), key)) - 1)


def _drawn(rows: DataFrame, key: str, n: int, there: int, seed: int) -> DataFrame:
    """n rows of the `there` ones, with draw from 0: each once at most; where there are fewer, n draws with repeats."""
    pool = _numbered(_first(rows, key, n, seed), key, seed)
    if there >= n or there == 0:
        return pool
    number = F.conv(F.substring(B.rank_key(F.concat(F.lit("draw:"), F.col("id").cast("string")), seed), 1, 6), 16, 10).cast("long") % there
    draws = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("again"), number.cast("int").alias("draw"))
    return draws.join(pool, "draw").drop("draw").withColumnRenamed("again", "draw")


# reports of styles


def style_samples(counts: DataFrame, key: str, targets: tuple[int, int, int], seed: int = 42) -> DataFrame:
    """(split, draw, key, event_count, layer) from counts(key, event_count), a row a style.

    Training samples are drawn from each layer by its share, what rounding leaves from the rich; a layer with fewer styles
    than wanted is drawn from with repeats, an empty one gives none. The other splits are poor styles that no split before
    them has, as many as there are.
    """
    train, val, test = targets
    wanted = {name: int(train * share) for name, share in LAYERS.items()}
    wanted["rich"] += train - sum(wanted.values())
    layered = counts.select(key, "event_count", B.layer(F.col("event_count")).alias("layer")).where("layer IS NOT NULL")
    there = {r.layer: r.n for r in layered.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()}  # three at most
    drawn = reduce(DataFrame.unionByName, [_drawn(layered.where(F.col("layer") == name), key, n, there.get(name, 0), seed) for name, n in wanted.items()])
    poor = layered.where("layer = 'poor'")
    left = poor.join(F.broadcast(drawn.select(key).distinct()), key, "left_anti")  # no more than the target
    second = _first(left, key, val, seed + 1)
    third = _first(left.join(F.broadcast(second.select(key)), key, "left_anti"), key, test, seed + 2)
    parts = [drawn, _numbered(second, key, seed + 1), _numbered(third, key, seed + 2)]
    return reduce(DataFrame.unionByName, [p.select(F.lit(name).alias("split"), F.col("draw").cast("long").alias("draw"), key, "event_count", "layer") for name, p in zip(SPLITS, parts, strict=True)])


def plain_answers(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, report) without a model: the plain report of each round of events, rounds put together."""
    return P.merged(P.plain_reports(O.chunks(rows, [key], order, ROUND), order, key), key)


def report_checks(text: Column) -> dict[str, Column]:
    flags = B.quality_flags(text)
    return {k: v for k, v in flags.items() if k.startswith("has_")} | {"has_icons": reduce(lambda a, b: a | b, [text.contains(i) for i in ICONS]), "passed": flags["passed"]}


def timeline_dataset(spark: SparkSession, path: str, events: DataFrame, order: list[str], system: str, key: str = "style_id", targets: tuple[int, int, int] = (500, 50, 50), answers: Callable[[DataFrame, str, list[str]], DataFrame] = plain_answers, seed: int = 42) -> Job:
    """Writes records of (system, a style's events by date, its report) by split, and the splits' figures.

    events(key, category, event_type, date, delay_days, ...) are read for their counts, then for the drawn styles alone.
    answers(events of drawn styles, key, order) gives a report a style: a model's place. A style that it leaves out has
    no record and shows in the figures as the difference of drawn and total. Events without a key are no style's; a null
    delay is no delay. A style's events are one text, as the format asks.
    """
    job = Job(spark, path)
    counts = job.step("counts", lambda: events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("event_count")))
    samples = job.step("samples", lambda: style_samples(counts, key, targets, seed))

    def records() -> DataFrame:
        ids = samples.select(key).distinct()  # no more than the targets
        own = events.join(F.broadcast(ids), key, "left_semi")
        line = F.concat_ws("|", F.coalesce("date", F.lit("")), "category", F.coalesce("delay_days", F.lit(0)).cast("string"))
        lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
        given = own.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["__line"]), "\n").alias("given"))
        said = given.join(answers(own, key, order), key)
        message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
        messages = F.array(message("system", F.lit(system)), message("user", F.col("given")), message("assistant", F.col("report")))
        return samples.join(said, key).select("split", "draw", key, "event_count", "layer", messages.alias("messages"))

    made = job.step("records", records)

    def figures() -> DataFrame:
        checks = report_checks(F.col("messages")[2]["content"])
        of = made.select("split", "event_count", "layer", *[v.alias(k) for k, v in checks.items()]).groupBy("split")
        lacking = [F.count_if(~F.col(k)).alias(f"no_{k.removeprefix('has_')}") for k in checks if k != "passed"]
        sums = of.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("quality_passed"), F.avg("event_count").alias("avg_events"), *[F.count_if(F.col("layer") == x).alias(x) for x in LAYERS], *lacking)
        shared = B.split_overlap(samples.select(key, "split").distinct(), key).agg(F.count(F.lit(1)).alias("overlapping"))
        drawn = samples.groupBy("split").agg(F.count(F.lit(1)).alias("drawn"))
        return drawn.join(sums, "split", "left").fillna(0).join(F.broadcast(shared), F.lit(True))

    _write(job, {"sft": made}, job.step("figures", figures))
    return job


# dialogues of questions


def question_samples(questions: DataFrame, key: str, targets: tuple[int, int, int], seed: int = 42) -> DataFrame:
    """(split, key, scene) of questions(key, scene, status), one row a key: those with status success, by shares of scenes.

    With more of them than the targets together each scene gives its share of the total, rounded down, in seeded order,
    and what is lacking comes from the rest at random. The draw is shuffled and cut into train, val and test. A null
    scene is the scene `unknown`. A scene passes on no more than the total from each task, so a scene that holds most
    questions costs no more than another.
    """
    total = sum(targets)
    good = questions.where("status = 'success'").select(key, F.coalesce("scene", F.lit("unknown")).alias("scene"))
    n = good.count()
    drawn = good
    if n > total:
        wanted = good.groupBy("scene").agg(F.floor(F.lit(total) * (F.count(F.lit(1)) / F.lit(n))).alias("wanted"))
        rank = F.row_number().over(Window.partitionBy("scene").orderBy(B.rank_key(F.col(key), seed), key))
        ranked = good.withColumn("rank", rank).where(F.col("rank") <= total)
        shares = ranked.join(wanted, "scene").where("rank <= wanted").select(key, "scene")
        lacking = total - (wanted.agg(F.sum("wanted")).first()[0] or 0)
        rest = good.join(F.broadcast(shares.select(key)), key, "left_anti")  # no more than the total
        drawn = shares.unionByName(_first(rest, key, lacking, seed + 1))
    at = F.col("draw")
    split = F.when(at < targets[0], "train").when(at < targets[0] + targets[1], "val").otherwise("test")
    return _numbered(drawn, key, seed + 2).select(split.alias("split"), key, "scene")


def turn_usage(text: Column) -> tuple[Column, Column]:
    """Whether an assistant's turn has a call with a result, and whether it is a chain: two calls of which the first
    names no style. A text that is no JSON has neither."""
    calls = F.from_json(text, _TURN)["function_calls"]
    some = lambda r: r.isNotNull() & ~r.isin("", "[]", "{}", "0", "false", "null")
    result = F.exists(calls, lambda c: some(c["result"]))
    free = F.size(F.array_intersect(F.coalesce(F.map_keys(calls[0]["params"]), F.array().cast("array<string>")), F.array(F.lit("style_id"), F.lit("style_ids")))) == 0
    chain = F.when(F.size(calls) == 2, calls[0]["name"].isin(*CHAINED) & calls[1]["name"].isin(*CHAINED) & free)
    return F.coalesce(result, F.lit(False)), F.coalesce(chain, F.lit(False))


def question_dataset(spark: SparkSession, path: str, questions: DataFrame, turns: Callable[[DataFrame], DataFrame], key: str = "question", targets: tuple[int, int, int] = (400, 50, 50), seed: int = 42) -> Job:
    """Writes dialogues and preference pairs of judged questions by split, and the splits' figures.

    questions(key, scene, status) come from a validation; turns(drawn questions) gives their dialogues as (key, turn,
    role, text): a model's place. A question without turns has no record, one without an assistant's turn no pair.
    """
    job = Job(spark, path)
    samples = job.step("samples", lambda: question_samples(questions, key, targets, seed))
    said = job.step("turns", lambda: turns(samples).select(key, "turn", "role", "text"))
    sft = job.step("sft", lambda: samples.join(B.sharegpt(said, key, "turn"), key))
    dpo = job.step("dpo", lambda: samples.join(B.dpo_pairs(said, key, "turn"), key))

    def figures() -> DataFrame:
        result, chain = turn_usage(F.col("text"))
        used = said.where("role = 'assistant'").select(key, result.cast("long").alias("result"), chain.cast("long").alias("chain"))
        one = sft.select("split", key).join(used.groupBy(key).agg(F.count(F.lit(1)).alias("rounds"), F.sum("result").alias("results"), F.sum("chain").alias("chains")), key, "left").fillna(0)
        by_rounds = one.groupBy("split", "rounds").agg(F.count(F.lit(1)).alias("n"), F.sum("results").alias("results"), F.sum("chains").alias("chains"))
        spread = F.array_sort(F.collect_list(F.struct("rounds", "n")))
        sums = by_rounds.groupBy("split").agg(F.sum("n").alias("sft_count"), F.sum("chains").alias("chain_count"), F.sum("results").alias("result_count"), spread.alias("round_distribution"))
        pairs = dpo.groupBy("split").agg(F.count(F.lit(1)).alias("dpo_count"))
        drawn = samples.groupBy("split").agg(F.count(F.lit(1)).alias("drawn"))
        return drawn.join(sums, "split", "left").join(pairs, "split", "left").fillna(0)

    _write(job, {"sft": sft, "dpo": dpo}, job.step("figures", figures))
    return job


def _write(job: Job, records: dict[str, DataFrame], figures: DataFrame) -> None:
    """JSON lines by split and one JSON file of figures, a line a split; a marker says that they are complete."""
    if "written" in job.marks.read_all():
        return
    for name, rows in records.items():
        writers.write_splits(rows, f"{job.path}/out/{name}")
    figures.coalesce(1).write.mode("overwrite").json(f"{job.path}/out/figures")
    job.marks.write_named("written", {})
    job.redone.append("written")
