"""Corrective question answering: retrieve, grade, broaden a bounded number of times, answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions.text import dedup_key, parse_grade, position_hint, strip_html
from corvane.operators.intervals import merge_chunks

REWRITE = "Rewrite the question as a search query. Answer with the query alone.\n\nQuestion: {question}"
GRADE = "Does the document help to answer the question?\nAnswer with two lines: 'relevant: yes' or 'relevant: no', and 'score: ' with a number from 0 to 1.\n\nQuestion: {question}\n\nDocument:\n{document}"
BROADEN = "The search found too little. Write a broader query. Answer with the query alone.\n\nQuestion: {question}\nLast query: {query}"
ANSWER = "Answer the question from the sources alone and name the sources used.\n\nQuestion: {question}\n\n{context}"
NOTHING = "The indexed documents don't answer this question. Try other words, or index more documents."


class ChatModel(Protocol):
    """A picklable language model: one prompt in, one reply out."""

    def __call__(self, prompt: str) -> str: ...


class StubModel:
    """Deterministic stand-in: echoes questions, and grades by words that question and document share."""

    def __call__(self, prompt: str) -> str:
        if "relevant: yes" in prompt:
            question, _, document = prompt.partition("Question: ")[2].partition("\n\nDocument:\n")
            shared = set(question.lower().split()) & set(document.lower().split())
            return f"relevant: {'yes' if shared else 'no'}\nscore: {len(shared) / max(1, len(set(question.lower().split()))):.4f}"
        if prompt.startswith("Answer"):
            return "Answer from: " + prompt.partition("\n\n")[2][:200]
        return prompt.rpartition(": ")[2].strip()


@dataclass
class State:
    query: str
    rewritten: str = ""
    broadened: str = ""
    broaden_count: int = 0
    retrievals: int = 0
    relevant: list[dict] = field(default_factory=list)
    answer: str = ""

    def search_query(self) -> str:
        """Broadened before rewritten before original; blank ones don't count."""
        return next((x for x in (self.broadened.strip(), self.rewritten.strip()) if x), self.query.strip())


def route(relevant: int, broadened: int, settings: Settings) -> str:
    return "broaden" if relevant < settings.min_relevant and broadened < settings.max_broaden else "answer"


def grade(chunks: DataFrame, question: str | None, model: Callable[[str], str]) -> DataFrame:
    """``chunks(source, content, ...)`` with ``relevant, score``; the model runs in Arrow batches on the executors.

    Without a ``question``, each chunk has its own in a column of that name.  The model sees the text of markup; blank texts are not relevant without asking the model; nor is a chunk for which the model fails.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            questions = pdf["question"] if question is None else [question] * len(pdf)
            for source, content, q in zip(pdf["source"], pdf["__text"], questions, strict=True):
                if not (content or "").strip():
                    replies.append("relevant: no")
                    continue
                try:
                    replies.append(model(GRADE.replace("{question}", q).replace("{document}", f"[Source: {source}]\n{content}")))
                except Exception:  # noqa: BLE001  whatever a model raises, the other chunks go on
                    replies.append("relevant: no")
            yield pdf.drop(columns="__text").assign(reply=replies)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    out = chunks.withColumn("__text", strip_html("content")).mapInPandas(ask, f"{fields}, reply string").withColumn("__g", parse_grade("reply"))
    return out.select(*chunks.columns, F.col("__g.relevant").alias("relevant"), F.col("__g.score").alias("score"))


def context(rows: list[dict], files: dict[str, str], limit: int, cap: int | None = None) -> str:
    """Numbered sources; a chunk of ``limit`` characters at most gives way to its whole file (up to ``cap`` characters, if given)."""
    parts = []
    for i, r in enumerate(rows, 1):
        whole = files.get(r["source"])
        text = whole[:cap] if whole is not None and len(r["content"]) <= limit else r["content"]
        hint = f" [chars {r['position_start']}-{r['position_end']}]" if r.get("position_start") is not None and r.get("position_end") is not None else ""
        parts.append(f"[Source {i}: {r['source']}{hint}]\n{text}")
    return "\n\n---\n\n".join(parts)


def answer_question(
    spark: SparkSession,
    question: str,
    search: Callable[[str, int], DataFrame],
    model: ChatModel,
    files: DataFrame | None = None,
    settings: Settings = Settings(),  # noqa: B008
) -> State:
    """Run the loop.  ``search(query, k)`` gives ``source, content, position_start, position_end, score``."""
    one = lambda asked: search(*asked[0]).withColumn("qid", F.lit(0).cast("long"))
    return answer_questions(spark, {0: question}, one, model, files, settings)[0]


def answer_questions(
    spark: SparkSession,
    questions: dict[int, str],
    search: Callable[[dict[int, tuple[str, int]]], DataFrame],
    model: ChatModel,
    files: DataFrame | None = None,
    settings: Settings = Settings(),  # noqa: B008
) -> dict[int, State]:
    """Run the loop for many questions side by side.  ``search({qid: (query, k)})`` gives ``qid, source, content, position_start, position_end, score``.

    A pass retrieves, leaves out what earlier passes saw of a question (by source and first 200 characters), merges neighbouring chunks,
    grades them and adds the new relevant ones.  What a pass holds of a question is bounded by ``top_k`` and the number of passes; so is what reaches the driver.
    """
    states = {i: State(q) for i, q in questions.items()}
    for state in states.values():
        state.rewritten = model(REWRITE.replace("{question}", state.query))
    seen: dict[int, set[str]] = {i: set() for i in states}
    keys: dict[int, set[str]] = {i: set() for i in states}
    asking = list(states)
    while asking:
        found = search({i: (states[i].search_query(), settings.top_k + len(seen[i])) for i in asking}).withColumn("__key", dedup_key("source", "content"))
        rows = [r for r in found.collect() if r["__key"] not in seen[r["qid"]]]  # top_k rows a question and those seen at most
        for r in rows:
            seen[r["qid"]].add(r["__key"])
        if rows:
            told = [r["metadata"] if "metadata" in found.columns else None for r in rows]
            batch = spark.createDataFrame(
                [((r["qid"], r["source"]), r["content"], r["position_start"], r["position_end"], m) for r, m in zip(rows, told, strict=True)],
                "place struct<qid: long, source: string>, content string, position_start long, position_end long, metadata map<string,string>",
            )
            merged = merge_chunks(batch, "place").select("place.qid", "place.source", "position_start", "position_end", "joined_from", "content", "metadata")
            asked = spark.createDataFrame([(i, states[i].query) for i in asking], "qid long, question string")
            graded = grade(merged.join(F.broadcast(asked), "qid"), None, model).where("relevant").orderBy("qid", F.col("score").desc(), "source", "position_start")
            for r in graded.drop("question").collect():
                i, key = r["qid"], f"{r['source']}::{r['content'][:200]}"
                if key not in keys[i]:
                    keys[i].add(key)
                    states[i].relevant.append({k: v for k, v in r.asDict().items() if k != "qid"})
        for i in asking:
            states[i].retrievals += 1
        asking = [i for i in asking if route(len(states[i].relevant), states[i].broaden_count, settings) == "broaden"]
        for state in (states[i] for i in asking):
            state.broaden_count += 1
            if state.broaden_count < settings.max_broaden:
                state.broadened = model(BROADEN.replace("{question}", state.query).replace("{query}", state.search_query()))
    texts = {}
    if files is not None:
        wanted = files.where(F.col("rel").isin(*{r["source"] for s in states.values() for r in s.relevant}))
        texts = {r["rel"]: r["text"] for r in wanted.select("rel", "text").collect()}  # files of the relevant chunks
    for state in states.values():
        prompt = ANSWER.replace("{question}", state.query).replace("{context}", context(state.relevant, texts, settings.answer_chunk_size))
        state.answer = model(prompt) if state.relevant else NOTHING
    return states


__all__ = ["ChatModel", "State", "StubModel", "answer_question", "answer_questions", "context", "grade", "position_hint", "route"]
