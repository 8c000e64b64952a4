"""Answering questions: gate, retrieval, policy, answer or fallback with a recorded reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdex.functions.language_gate import is_polish
from helpdex.functions.text import label, trimmed
from helpdex.operators.embedding import Embedder, post_json
from helpdex.operators.retrieval import retrieve, with_document
from helpdex.plans.skew import cut
from helpdex.sources.config import NO_ANSWER, NOT_POLISH, POLISH_ONLY, Config

BY_LANGUAGE, BELOW, NO_MODEL_ANSWER = "language", "below_threshold", "llm_no_answer"
SOURCE = "struct<path: string, title: string, url: string, score: double, text: string>"


class Chatter(Protocol):
    def chat(self, rows: DataFrame, system: str, prompt_col: str) -> DataFrame:
        """``rows`` with ``reply`` (trimmed) and ``chat_error`` (null if it went well)."""


@dataclass(frozen=True)
class HttpChatter:
    """A chat endpoint asked from the tasks, one question at a time."""

    base_url: str
    model: str
    temperature: float = 0.1
    timeout_sec: float = 300
    api_key: str = ""

    def ask(self, system: str, prompt: str) -> tuple[str | None, str | None]:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        try:
            reply = post_json(f"{self.base_url.rstrip('/')}/chat/completions", {"model": self.model, "messages": messages, "temperature": self.temperature, "stream": False}, self.api_key, self.timeout_sec)
            return reply["choices"][0]["message"]["content"].strip(), None
        except (RuntimeError, OSError, LookupError, TypeError, AttributeError) as e:
            return None, str(e) or type(e).__name__

    def chat(self, rows: DataFrame, system: str, prompt_col: str) -> DataFrame:
        return asked_model(rows, lambda prompt: self.ask(system, prompt), prompt_col)


def asked_model(rows: DataFrame, ask: Callable[[str], tuple[str | None, str | None]], prompt_col: str) -> DataFrame:
    """``rows`` with the reply and the error of ``ask`` for each prompt."""

    @F.pandas_udf("struct<reply: string, chat_error: string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ask(p) for p in prompts], columns=["reply", "chat_error"])

    return rows.withColumn("said", run(F.col(prompt_col))).withColumns({"reply": F.col("said.reply"), "chat_error": F.col("said.chat_error")}).drop("said")


def two_decimals(score: Column) -> Column:
    return F.format_number(score, 2)


def prompt(question: Column, sources: Column) -> Column:
    """The numbered sources, then the question."""
    blocks = F.transform(sources, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), label(s["title"], s["path"]), F.lit(" ("), s["path"], F.lit(")\n"), s["text"], F.lit("\n\n")))
    return F.concat(F.lit("Knowledge base articles:\n\n"), F.array_join(blocks, ""), F.lit("Question: "), question)


def fragments(sources: Column) -> Column:
    """The sources with their scores (two decimals) and addresses, parted by rules."""
    blocks = F.transform(sources, lambda s: F.concat(F.lit("["), label(s["title"], s["path"]), F.lit(", "), two_decimals(s["score"]), F.lit("]\n"), s["text"], F.when(s["url"] != "", F.concat(F.lit("\n"), s["url"])).otherwise("")))
    return F.array_join(blocks, "\n\n---\n\n")


def judged_hits(hits: DataFrame, min_score: float, max_gap: float) -> DataFrame:
    """(qid, top_score, top_path, sources): the best document of each question, and those that pass as ``relevant`` does, in order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.struct("path", "title", "url", "score", "text").alias("s"))))
    rows = hits.groupBy("qid").agg(F.transform(ranked, lambda r: r["s"]).alias("all"))
    least = F.greatest(F.lit(min_score), F.col("all")[0]["score"] - F.lit(max_gap)) if max_gap > 0 else F.lit(min_score)
    return rows.select("qid", F.col("all")[0]["score"].alias("top_score"), F.col("all")[0]["path"].alias("top_path"), F.filter("all", lambda s: s["score"] >= least).alias("sources"))


def ask(questions: DataFrame, entries: DataFrame, docs: DataFrame, config: Config, embedder: Embedder, chatter: Chatter | None = None) -> DataFrame:
    """(qid, question, answered, answer, reason, top_score, top_path, sources, error) of every (qid, question) row.

    The first that applies: blank question (error), gate (``language``, no search), nothing relevant
    (``below_threshold``), fragments if there is no chat model, model error (error), reply that the question is not
    Polish (``language``), no answer in the reply (``llm_no_answer``), else the reply. Unanswered rows have the message
    for their reason and no sources. A qid must be unique; rows with a null qid are left out.
    """
    asked = questions.where(F.col("qid").isNotNull()).select("qid", trimmed(F.coalesce("question", F.lit(""))).alias("question"))
    blank = asked.where("question = ''")
    gate = is_polish(F.col("question")) if config.language.expected == "pl" else F.lit(True)
    gated = asked.where("question != ''").withColumn("polish", gate)
    foreign, open_ = gated.where("not polish").drop("polish"), gated.where("polish").drop("polish")
    nothing = F.lit(None).cast("string")

    def outcome(rows: DataFrame, answered: Column, answer: Column, reason: Column, error: Column = nothing) -> DataFrame:
        kept = F.when(answered, F.col("sources")) if "sources" in rows.columns else F.lit(None).cast(f"array<{SOURCE}>")
        top = [F.col(c) if c in rows.columns else F.lit(d).alias(c) for c, d in (("top_score", 0.0), ("top_path", ""))]
        return rows.select("qid", "question", answered.alias("answered"), answer.alias("answer"), reason.alias("reason"), *top, F.coalesce(kept, F.array().cast(f"array<{SOURCE}>")).alias("sources"), error.alias("error"))

    no, yes, fallback = F.lit(False), F.lit(True), F.lit(config.fallback_message)
    out = outcome(blank, no, nothing, nothing, F.lit("empty question"))
    out = out.unionByName(outcome(foreign, no, F.lit(config.language.other_message), F.lit(BY_LANGUAGE)))
    prefixed = open_.withColumn("query", F.concat(F.lit(config.embedding.query_prefix), "question"))
    vectors = embedder.embed(prefixed, "query").select("qid", F.col("vec").alias("qvec"))
    hits = with_document(retrieve(vectors, entries, config.search.top_k), docs)
    found = open_.join(judged_hits(hits, config.search.min_score, config.search.max_gap), "qid", "left").withColumns(
        {"top_score": F.coalesce("top_score", F.lit(0.0)), "top_path": F.coalesce("top_path", F.lit("")), "sources": F.coalesce("sources", F.array().cast(f"array<{SOURCE}>"))}
    )
    has = F.size("sources") > 0
    if config.answer.mode == "fragments" or chatter is None:
        return out.unionByName(outcome(found, has, F.when(has, fragments(F.col("sources"))).otherwise(fallback), F.when(~has, F.lit(BELOW))))
    # two branches read it, and the model must be asked once
    found = cut(found)
    out = out.unionByName(outcome(found.where(~has), no, fallback, F.lit(BELOW)))
    ready = found.where(has)
    system = config.answer.system_prompt
    if config.language.expected == "pl":
        system = system.rstrip("\n") + "\n" + POLISH_ONLY
    replied = chatter.chat(ready.withColumn("prompt", prompt(F.col("question"), F.col("sources"))), system, "prompt")
    return out.unionByName(judged(replied, config, outcome))


def judged(replied: DataFrame, config: Config, outcome: Callable[..., DataFrame]) -> DataFrame:
    """The outcomes of model replies."""
    reply, nothing = F.coalesce("reply", F.lit("")), F.lit(None).cast("string")
    failed = F.col("chat_error").isNotNull()
    foreign = ~failed & F.lit(config.language.expected == "pl") & F.contains(reply, F.lit(NOT_POLISH))
    empty = ~failed & ~foreign & ((reply == "") | F.contains(reply, F.lit(NO_ANSWER)))
    answered = ~failed & ~foreign & ~empty
    answer = F.when(foreign, F.lit(config.language.other_message)).when(empty, F.lit(config.fallback_message)).when(answered, reply)
    reason = F.when(foreign, BY_LANGUAGE).when(empty, NO_MODEL_ANSWER)
    return outcome(replied, answered, answer, reason, F.when(failed, F.col("chat_error")).otherwise(nothing))
