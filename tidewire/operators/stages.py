"""Articles through processing stages, each skipped where its result is there; failures are rows of the run log.

A stage names the rows that lack its result, a reply for these rows and what the
reply changes. Replies are Column rules or a model that is asked in Arrow batches;
a model's call is made once a row and attempt, and again where an executor is lost
before its rows are written. An article whose reply is an error goes no further and
keeps what earlier stages gave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import rules, text
from tidewire.operators.tables import written

Reply = Callable[[Column], Column]
_COMMON = "model string, input_tokens bigint, output_tokens bigint, error string"
_RUN = "struct<stage:string,status:string,model:string,error:string,input_tokens:bigint,output_tokens:bigint>"


@dataclass(frozen=True)
class Stage:
    """One step: ``reply`` for rows where ``lacking`` holds, what it changes, and which rows then stop."""

    name: str
    lacking: Column
    reply: Reply
    changes: dict[str, Callable[[Column], Column]]
    stops: Column | None = None
    logged: bool = True


def by_rule(fields: dict[str, Column], *, model: str | None = None, error: Column | None = None, tokens: tuple[Column, Column] | None = None) -> Reply:
    """A reply out of Columns; ``error`` is null where there is one."""
    used = tokens or (F.lit(0), F.lit(0))
    common = [F.lit(model).cast("string").alias("model"), used[0].cast("long").alias("input_tokens"), used[1].cast("long").alias("output_tokens"), (F.lit(None) if error is None else error).cast("string").alias("error")]
    return lambda due: F.when(due, F.struct(*[c.alias(n) for n, c in fields.items()], *common))


def by_model(make: Callable[[], Callable[[dict], dict]], inputs: dict[str, Column], fields: str) -> Reply:
    """A reply of a client that each task makes once it has a row to ask for.

    The client takes the inputs of a row and gives a dictionary with ``fields`` and, if
    it likes, ``model`` and tokens; what it raises is the row's error, cut at 1,000
    characters.
    """
    names, columns = list(inputs), [p.split()[0] for p in f"{fields}, {_COMMON}".split(", ")]

    def answered(client, row: dict) -> dict:
        try:
            return client(row)
        except Exception as failure:  # noqa: BLE001 - a row's failure is its result
            return {"error": (str(failure) or type(failure).__name__)[:1000]}

    def ask(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        client = None
        for due, *values in batches:
            client = client or (make() if due.any() else None)
            told = [answered(client, dict(zip(names, row, strict=True))) if on else {} for on, *row in zip(due, *values, strict=True)]
            yield pd.DataFrame({c: pd.Series([t.get(c) for t in told], dtype=object) for c in columns})

    asked = F.pandas_udf(ask, f"{fields}, {_COMMON}").asNondeterministic()
    return lambda due: F.when(due, asked(due, *inputs.values()))


def process(rows: DataFrame, stages: list[Stage], *, error_stage: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows after the stages in order, with ``runs``: one entry a reply, ``error`` or ``ok``.

    A failure is logged under the stage's name, or under ``error_stage``. What comes out
    (the columns ``keep``, or all) is written once to the shared folder: log, counts and
    results read it there and ask no model again.
    """
    out = through(rows, stages, error_stage=error_stage)
    return written(out.select(*keep, "runs") if keep else out, "processed")


def through(rows: DataFrame, stages: list[Stage], *, error_stage: str | None = None) -> DataFrame:
    """``process`` as a plan that is not written; no stage shuffles, rows stay where they are read."""
    due, reply, going, failed = F.col("_due"), F.col("_reply"), F.col("_going"), F.col("_failed")
    out, logs = rows.withColumn("_going", F.lit(True)), [F.lit(None).cast(_RUN)]
    for place, s in enumerate(stages):
        out = out.withColumn("_due", going & F.coalesce(s.lacking, F.lit(False)))
        out = out.withColumn("_reply", s.reply(due)).withColumn("_failed", due & reply["error"].isNotNull())
        name = F.when(failed, error_stage or s.name).otherwise(s.name)
        zero = lambda n: F.when(failed, 0).otherwise(F.coalesce(reply[n], F.lit(0))).cast("long").alias(n)
        run = F.struct(name.alias("stage"), F.when(failed, "error").otherwise("ok").alias("status"), reply["model"].alias("model"), reply["error"].alias("error"), zero("input_tokens"), zero("output_tokens"))
        said = failed | (due & F.lit(s.logged))
        changed = {c: F.when(due & ~failed, change(reply)).otherwise(F.col(c)) for c, change in s.changes.items()}
        out, logs = out.withColumns({**changed, f"_run_{place}": F.when(said, run)}), [*logs, F.col(f"_run_{place}")]
        out = out.withColumn("_going", going & ~failed & ~F.coalesce(F.lit(False) if s.stops is None else s.stops, F.lit(False)))
    return out.withColumn("runs", F.array_compact(F.array(*logs))).select(*rows.columns, "runs")


def run_log(processed: DataFrame, key: str) -> DataFrame:
    """The log: a row for each reply, in the order of the stages."""
    return processed.select(key, F.posexplode("runs").alias("turn", "r")).select(key, "turn", "r.*")


def counts(processed: DataFrame, names: list[str]) -> DataFrame:
    """One row: articles, verdicts, failures and the good replies of each named stage."""
    good = lambda n: F.exists("runs", lambda r: (r["stage"] == n) & (r["status"] == "ok"))
    tally = {"processed": F.count("*"), "relevant": F.count_if("relevant"), "rejected": F.count_if(~F.col("relevant")), "errors": F.count_if(F.exists("runs", lambda r: r["status"] == "error"))}
    return processed.agg(*[c.alias(n) for n, c in tally.items()], *[F.count_if(good(n)).alias(n) for n in names])


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def total_score(searched: Column, criteria: list[tuple[int, float, list[str]]], model_scores: Column) -> Column:
    """The weighted total over criteria ``(id, weight, keywords)``; ``model_scores`` maps ids to the model's scores, those that it gave."""
    if round(sum(w for _, w, _ in criteria), 2) != 100:
        raise ValueError("the weights of the criteria have to add up to 100")
    part = lambda t, i, words: text.once(text.keyword_score(t, words), lambda k: rules.final_score(k, F.try_element_at(model_scores, F.lit(i))))

    def total(t: Column) -> Column:
        parts = [part(t, i, words) * w / 100 for i, w, words in criteria]
        return sum(parts[1:], parts[0])

    return text.once(text.once(searched, total), lambda s: rules.decimal_round(rules.clamp(s), 2))


def article_stages(replies: dict[str, Reply], *, tags: list[tuple[int, list[str]]], stop_words: list[tuple[str, list[str]]], criteria: list[tuple[int, float, list[str]]], fallback_tag: int) -> list[Stage]:
    """The stages of an article: stop words, relevance, summary, title, tag, score.

    Rows hold title, raw_text, category, relevant, relevance_reason, summary, title_ru,
    tag_id and total_score. ``replies`` has relevance (relevant, reason), summary
    (summary), translation (title_ru), tagging (tag_id) and scoring (scores, a map). A
    stop word rejects whatever an earlier verdict said; titles in Cyrillic are kept
    without asking; a tag that there is not gives way to the one with the most keywords.
    """
    if not tags:
        raise ValueError("there are no tags")
    searched = rules.search_text(*map(F.col, ("title", "summary", "raw_text", "category")))
    title, verdict = F.trim(F.coalesce("title", F.lit(""))), F.col("relevant")
    blocked, foreign = rules.stop_word_reason(searched, stop_words) if stop_words else F.lit(None).cast("string"), text.needs_translation(title)
    known = lambda r: F.when(r["tag_id"].isin([t for t, _ in tags]), r["tag_id"])
    translated = lambda r: F.substring(F.coalesce(F.nullif(F.trim(r["title_ru"]), F.lit("")), title), 1, 200)
    return [
        Stage("stop_words", blocked.isNotNull(), by_rule({"reason": blocked}), {"relevant": lambda r: F.lit(False), "relevance_reason": lambda r: r["reason"]}, ~verdict, logged=False),
        Stage("relevance", verdict.isNull(), replies["relevance"], {"relevant": lambda r: F.coalesce(r["relevant"], F.lit(False)), "relevance_reason": lambda r: r["reason"]}, ~verdict),
        Stage("summary", _blank("summary"), replies["summary"], {"summary": lambda r: r["summary"]}),
        Stage("own_title", _blank("title_ru") & (title != "") & ~foreign, by_rule({"title_ru": title}), {"title_ru": translated}, logged=False),
        Stage("translation", _blank("title_ru") & foreign, replies["translation"], {"title_ru": translated}),
        Stage("tagging", F.col("tag_id").isNull(), replies["tagging"], {"tag_id": lambda r: F.coalesce(known(r), rules.keyword_tag(searched, tags, fallback_tag)["tag_id"])}),
        Stage("scoring", F.col("total_score").isNull(), replies["scoring"], {"total_score": lambda r: total_score(searched, criteria, r["scores"])}),
    ]


def recheck(rows: DataFrame, stages: list[Stage], protected: DataFrame, key: str) -> DataFrame:
    """What becomes of each row when relevance is asked anew: kept, deleted, skipped_in_digest or error.

    ``protected`` has the keys that a saved digest holds; the stages are stop words and
    relevance, and earlier verdicts do not count.
    """
    anew = process(rows.withColumn("relevant", F.lit(None).cast("boolean")), stages, keep=[key, "relevant", "relevance_reason"])
    held = protected.select(key).distinct().withColumn("_held", F.lit(True))
    wrong = F.exists("runs", lambda r: r["status"] == "error")
    outcome = F.when(wrong, "error").when(F.col("relevant"), "kept")
    return anew.join(held, key, "left").select(key, outcome.when(F.col("_held"), "skipped_in_digest").otherwise("deleted").alias("outcome"), "relevance_reason", "runs")


def job_results(jobs: DataFrame, articles: DataFrame, stages: list[Stage], now: Column) -> DataFrame:
    """Results of batch jobs away from the tables: no earlier result counts, and only a job that still holds its lease delivers.

    ``jobs`` has job_id, article_ids, status, lease_token, held_token (of who works) and
    lease_expires_at; ``articles`` has id and what the stages read. Jobs whose lease is
    lost are not worked on; ids without an article give nothing. As no earlier result
    counts, an article that several jobs name goes through the stages once.
    """
    holds = (F.col("status") == "running") & (F.col("lease_token") == F.col("held_token")) & (F.col("lease_expires_at") >= now)
    asked = jobs.where(holds).select("job_id", F.explode(F.array_distinct("article_ids")).alias("id"))
    empty = {"relevant": "boolean", "relevance_reason": "string", "summary": "string", "title_ru": "string", "tag_id": "long", "total_score": "double"}
    named = articles.drop(*empty).join(asked.select("id").distinct(), "id", "left_semi")
    fresh = named.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    return asked.join(process(fresh, stages, keep=["id", *empty]), "id")
