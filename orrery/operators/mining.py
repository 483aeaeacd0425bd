"""From clustered issues to reviewed patterns: classify, cluster, name, draft, score, review, promote.

Defined cases: issues without labels go by their words, without either they are unknown; vectors that are null or empty take no part; a
model's failure is its row's own; an empty input, or one without issues of the intent, is an error; ids of issues must be unique.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, folders, text
from . import matching, vectors

INTENTS = ("bug", "feature_request", "enhancement", "refactor")
STATUSES = ("pending", "approved", "rejected", "promoted")
DRAFT = "draftAlias array<string>, draftSymptoms array<string>, draftSymbols array<string>, draftCategory string"
#: What a generated pattern says where a reviewer has not said anything yet (fixed values).
NOT_FILLED = {
    "symptoms": "(no symptoms drafted — fill in before merge)", "possibleCauses": "(possible causes not yet filled by reviewer)", "relatedSymbols": "(no symbols drafted)",
    "investigationSteps": "(investigation steps not yet filled by reviewer)", "fixSuggestions": "(fix suggestions not yet filled by reviewer)",
}


class Backend(Protocol):
    """What completes a prompt."""

    def complete(self, prompt: str) -> str: ...


class HttpBackend:
    """A model behind HTTP, of either of two dialects: `generate` (prompt in, response out) or `chat` (messages in, choices out)."""

    def __init__(self, url: str, model: str, dialect: str = "chat", key: str | None = None, retries: int = 2, timeout: float = 60, wait: float = 1.0) -> None:
        self.url, self.model, self.dialect, self.key, self.retries, self.timeout, self.wait = url.rstrip("/"), model, dialect, key, retries, timeout, wait

    def _request(self, prompt: str) -> tuple[str, dict[str, Any]]:
        if self.dialect == "generate":
            return f"{self.url}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0.2}}
        return f"{self.url}/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0.2}

    def complete(self, prompt: str) -> str:
        path, body = self._request(prompt)
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(path, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
                    said = json.loads(r.read())
                return said["response"] if self.dialect == "generate" else said["choices"][0]["message"]["content"]
            except urllib.error.HTTPError:
                raise
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(self.wait * (attempt + 1))
        raise AssertionError("unreachable")


def _completed(frame: DataFrame, prompt: str, backend: Backend, column: str) -> DataFrame:
    """``frame`` with the backend's answer to `prompt`; an error becomes a text that says so."""
    from pyspark.sql import types as T

    schema = T.StructType([*frame.schema.fields, T.StructField(column, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(p: str) -> str:
            try:
                return backend.complete(p)
            except Exception as e:  # noqa: BLE001  a failed item must not fail the others
                return f"ERROR: {e}"

        for b in batches:
            said = pa.array([one(p) for p in b.column(prompt).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, said], names=[*b.schema.names, column])

    return frame.mapInArrow(run, schema)


def parse_intent(raw: str | Column) -> Column:
    """A struct of intent, confidence and reason from a model's answer: its JSON, else the word it mentions, else unknown."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    inner = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?im)^```(?:json)?\s*", ""), r"(?im)\s*```$", ""))
    got = F.from_json(inner, "intent string, confidence double, reason string, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    fine = got.isNotNull() & got["_corrupt_record"].isNull() & F.startswith(inner, F.lit("{"))
    make = lambda i, c, r: F.struct(i.cast("string").alias("intent"), c.cast("double").alias("confidence"), r.cast("string").alias("reason"))
    good = make(F.when(got["intent"].isin(*INTENTS), got["intent"]).otherwise(F.lit("unknown")), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(got["confidence"], F.lit(0.5)))), got["reason"])
    low = F.lower(raw)
    return (
        F.when(F.startswith(raw, F.lit("ERROR: ")), make(F.lit("unknown"), F.lit(0.1), F.concat(F.lit(fixed.MESSAGES["model_error"]), F.substring(raw, 8, 10_000))))
        .when(fine, good)
        .when(F.contains(low, F.lit("bug")), make(F.lit("bug"), F.lit(0.6), F.lit(fixed.MESSAGES["model_bug"])))
        .when(F.contains(low, F.lit("feature")), make(F.lit("feature_request"), F.lit(0.5), F.lit(fixed.MESSAGES["model_feature"])))
        .otherwise(make(F.lit("unknown"), F.lit(0.2), F.lit(fixed.MESSAGES["model_unread"])))
    )


def classify(issues: DataFrame, backend: Backend | None = None, least: float = 0.6, only_model: bool = False) -> DataFrame:
    """Intents by rule; with a backend, a model is asked where the rule is less sure than `least`, or always."""
    if backend is None:
        return matching.intents(issues)
    # dealt over all cores, and stored: the filters below would have the rules worked out again, before the rows are dealt
    ruled = folders.stored(matching.intents(folders.few_splits(issues)), "ruled")
    sure = F.lit(False) if only_model else F.col("confidence") >= least
    ask = F.concat(F.lit("Classify this issue as bug, feature_request, enhancement or refactor. Answer with JSON: intent, confidence, reason.\n\nTitle: "), "title", F.coalesce(F.concat(F.lit("\nLabels: "), F.nullif(F.array_join("labels", ", "), F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit("\nBody: "), F.substring("body", 1, 500)), F.lit("")))
    asked = _completed(ruled.where(~sure).withColumn("__prompt", ask), "__prompt", backend, "__raw").withColumn("__i", parse_intent("__raw"))
    new = asked.withColumns({"intent": F.col("__i.intent"), "confidence": F.col("__i.confidence"), "method": F.lit("llm"), "reason": F.col("__i.reason")})
    return ruled.where(sure).unionByName(new.select(*ruled.columns))


def canonical_problems(clusters: DataFrame) -> DataFrame:
    """One problem per cluster (cluster_id, size, score, members): surer the more alike and the more there are."""
    confidence = F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)) * 0.5 + F.col("size") * 0.05)
    first = F.get(F.filter("members", lambda m: F.startswith(m, F.lit("issue:"))), F.lit(0))
    empty = F.array().cast("array<string>")
    return clusters.select(
        F.concat(F.lit("canonical/"), F.substring(F.sha1(F.array_join("members", ",")), 1, 12)).alias("id"), F.lit("").alias("title"), empty.alias("aliases"), F.regexp_replace(first, "^issue:", "").alias("representative_issue_id"),
        F.array("cluster_id").alias("cluster_ids"), F.filter("members", lambda m: ~F.startswith(m, F.lit("issue:"))).alias("experience_ids"), confidence.alias("confidence"), F.lit("candidate").alias("status"),
    )


def draft_prompt(title: Column, confidence: Column, aliases: Column, members: Column) -> Column:
    listed = F.array_join(F.transform(members, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), m)), "\n")
    none = lambda c, word: F.coalesce(F.nullif(c, F.lit("")), F.lit(word))
    return F.concat(
        F.lit("Describe what these reports have in common as one problem pattern. Answer with JSON only.\n\n## Problem\nTitle: "), none(title, "(unnamed)"), F.lit("\nConfidence: "), F.format_string("%.2f", confidence), F.lit("\nAliases: "), none(F.array_join(aliases, ", "), "(none)"),
        F.lit("\n\n## Reports\n"), listed, F.lit('\n\n## Fields\n"draftAlias": 3 to 8 short names; "draftSymptoms": 2 to 5 things users see; "draftSymbols": 3 to 8 class or function names; "draftCategory": one of ' + ", ".join(fixed.CATEGORIES)),
    )


def parse_draft(raw: str | Column) -> Column:
    """A struct of a draft's fields from an answer: its fenced or bare JSON; else one that holds the text itself."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    fenced = F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1)
    inner = F.trim(F.when(fenced != "", fenced).otherwise(raw))
    got = F.from_json(inner, DRAFT + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    fine = got.isNotNull() & got["_corrupt_record"].isNull() & F.startswith(inner, F.lit("{"))
    empty = F.array().cast("array<string>")
    failed = F.startswith(raw, F.lit("ERROR: "))
    make = lambda a, s, y, c: F.struct(a.alias("draft_alias"), s.alias("draft_symptoms"), y.alias("draft_symbols"), c.cast("string").alias("draft_category"), failed.alias("failed_draft"))
    return (
        F.when(failed, make(empty, empty, empty, F.lit(None)))
        .when(fine, make(F.coalesce(got["draftAlias"], empty), F.coalesce(got["draftSymptoms"], empty), F.coalesce(got["draftSymbols"], empty), got["draftCategory"]))
        .otherwise(make(F.array(F.lit("unknown_pattern")), F.array(F.substring(inner, 1, 500)), empty, F.lit("debug")))
    )


def draft(problems: DataFrame, backend: Backend) -> DataFrame:
    """Problems (id, title, confidence, aliases, cluster_id, summaries) with the backend's drafts; a failure is one row's own."""
    asked = problems.withColumn("__prompt", draft_prompt(F.col("title"), F.col("confidence"), F.col("aliases"), F.col("summaries")))
    return _completed(asked, "__prompt", backend, "llm_raw").withColumn("__d", parse_draft("llm_raw")).select(*problems.columns, "llm_raw", "__d.*")


def candidates(drafts: DataFrame) -> DataFrame:
    """Rows of the candidate table from drafts (with canonical_id, cluster_id, best_score, dup_of and the three counts)."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    total = n("issue_count") + n("forum_count") + n("experience_count")
    key = F.substring(F.sha1(F.concat_ws("/", "canonical_id", "cluster_id")), 1, 12)
    return drafts.select(
        F.concat(F.lit("candidate/"), key).alias("id"), "canonical_id", "cluster_id", "draft_alias", "draft_symptoms", "draft_symbols", "draft_category", "llm_raw", F.col("best_score").alias("quality_score"), "dup_of", "failed_draft",
        F.lit("pending").alias("status"), F.lit(None).cast("long").alias("reviewed_at"), F.unix_millis(F.current_timestamp()).alias("created_at"), total.alias("source_count"), n("issue_count").alias("issue_count"), n("forum_count").alias("forum_count"), n("experience_count").alias("experience_count"),
    )


def of_intent(issues: DataFrame, intent: str) -> DataFrame:
    return issues.where(F.col("intent") == intent)


def review(found: DataFrame, problems: DataFrame, status: str = "pending", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of candidates of a status, newest first, each with its problem's title, what it comes from, and how many there are."""
    from .relational import page

    chosen = found.where(F.col("status") == status)
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    rows = page(chosen, [F.desc("created_at"), "id"], limit, offset)
    titles = problems.select(F.col("id").alias("canonical_id"), F.col("title").alias("__title"))
    told = F.format_string("src=%d(i=%d/f=%d/e=%d)", "source_count", "issue_count", "forum_count", "experience_count")
    return rows.join(titles, "canonical_id", "left").crossJoin(F.broadcast(total)).select(
        "id", F.coalesce("draft_category", F.lit("?")).alias("category"), "dup_of", "failed_draft", "canonical_id", F.coalesce(F.nullif("__title", F.lit("")), F.lit("(untitled)")).alias("title"),
        F.slice("draft_alias", 1, 6).alias("aliases"), F.size("draft_symptoms").alias("symptoms"), F.size("draft_symbols").alias("symbols"), told.alias("sources"), "total",
    )


def stats(found: DataFrame) -> DataFrame:
    """Candidates by status, those of no row counting 0, with the share approved."""
    from .relational import counts_over

    by = counts_over(found, "status", STATUSES)
    return by.withColumn("rate", F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)))


def run(issues: DataFrame, points: DataFrame, patterns: DataFrame, backend: Backend, threshold: float = 0.9, least: int = 2, most: int | None = None, intent: str = "bug", since: str | None = None, duplicate: float = 0.9, embed: Callable[[list[str]], list[list[float]]] | None = None) -> dict[str, DataFrame]:
    """Mine candidates from issues (id, title, body, labels, updated_at) and their vectors (id, vector).

    Gives clusters, problems and candidates. Empty inputs, or none of the intent, are errors.
    """
    rows = issues if since is None else issues.where(F.col("updated_at") >= since)
    chosen = rows if intent == "unknown" else of_intent(classify(rows), intent)
    named = chosen.select(F.concat(F.lit("issue:"), F.col("id").cast("string")).alias("id"), "title", "body")
    kept = points.where(F.size("vector") > 0).select("id", "vector").join(named, "id")
    if points.isEmpty():
        raise ValueError("no vectors found")
    if kept.isEmpty():
        raise ValueError(f"no issues matched the intent {intent!r}")
    # stored, so that neither the clustering nor the model's answers are ever made twice
    folders.shared(issues.sparkSession)
    member = vectors.clusters(kept.select("id", "vector"), threshold, least, most).join(kept, "id").checkpoint()
    close = vectors.cohesion(member).select("cluster_id", "size", "score")
    summary = F.concat("title", F.coalesce(F.concat(F.lit("\n  "), F.nullif(F.substring("body", 1, 200), F.lit(""))), F.lit("")))
    listed = member.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", summary.alias("s")))).alias("m"))
    whole = listed.join(close, "cluster_id").select("cluster_id", "size", "score", F.transform("m", lambda x: x["id"]).alias("members"), F.transform("m", lambda x: x["s"]).alias("summaries")).checkpoint()
    problems = canonical_problems(whole)
    many = problems.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if many:
        raise ValueError(f"several clusters make one problem: {many[0]['id']}")
    asked = problems.withColumn("cluster_id", F.col("cluster_ids")[0]).join(whole.select("cluster_id", "summaries", "size"), "cluster_id").select(F.col("id").alias("canonical_id"), "cluster_id", "title", "confidence", "aliases", "summaries", F.col("size").alias("issue_count"))
    drafts = draft(asked, backend).checkpoint()
    probe = vectors.embed(drafts.select(F.col("canonical_id").alias("id"), F.concat_ws(" ", F.array_join("draft_alias", " "), F.array_join("draft_symptoms", " ")).alias("t")), "t", embed)
    score = vectors.duplicates(probe.where("vector is not null"), patterns.select("id", "vector"), duplicate).select(F.col("id").alias("canonical_id"), F.col("score").alias("best_score"), "dup_of")
    full = drafts.join(score, "canonical_id", "left").withColumns({"forum_count": F.lit(0), "experience_count": F.lit(0)})
    return {"clusters": whole, "problems": problems, "candidates": candidates(full)}


# --- promotion ------------------------------------------------------------------------------------------------------


def generated_patterns(found: DataFrame, problems: DataFrame) -> DataFrame:
    """Approved candidates that did not fail, as patterns; what nobody filled says so."""
    c = found.where("status = 'approved' and not failed_draft").alias("c")
    p = problems.alias("p")
    empty = F.array().cast("array<string>")
    aliases = F.array_union(F.coalesce("p.aliases", empty), F.coalesce("c.draft_alias", empty))
    key = text.safe_id(F.coalesce(F.get("p.aliases", F.lit(0)), F.get("c.draft_alias", F.lit(0)), F.col("c.id")))
    filled = lambda x, name: F.when(F.size(F.coalesce(x, empty)) > 0, F.col(x)).otherwise(F.array(F.lit(NOT_FILLED[name])))
    category = F.when(F.col("c.draft_category").isin(*fixed.CATEGORIES), F.col("c.draft_category")).otherwise(F.lit("debug"))
    keywords = F.when(F.size(F.coalesce("c.draft_alias", empty)) > 0, F.array_distinct("c.draft_alias")).otherwise(F.array(key))
    said = lambda name: F.array(F.lit(NOT_FILLED[name])).alias(name)
    return c.join(p, F.col("c.canonical_id") == F.col("p.id")).select(
        key.alias("id"), F.coalesce(F.nullif(F.col("p.title"), F.lit("")), key).alias("name"), category.alias("category"), F.lit("medium").alias("severity"), aliases.alias("aliases"), keywords.alias("triggerKeywords"),
        filled("c.draft_symptoms", "symptoms").alias("symptoms"), said("possibleCauses"), filled("c.draft_symbols", "relatedSymbols").alias("relatedSymbols"), empty.alias("relatedStages"), F.slice(aliases, 1, 5).alias("issueQueries"),
        said("investigationSteps"), said("fixSuggestions"), F.col("c.id").alias("candidateId"), F.col("p.id").alias("canonicalId"), F.col("c.cluster_id").alias("clusterId"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("promotedAt"), F.col("c.source_count").alias("sourceCount"),
    )


def promote(entries: DataFrame, path: str | Path, most: int = 1000) -> int:
    """Put generated patterns into a JSON file, one per candidate; an id that another candidate has is an error. A reviewer's file is
    small: more than `most` entries at once are refused."""
    rows = [r.asDict(recursive=True) for r in entries.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} patterns at once")
    target = Path(path)
    held = json.loads(target.read_text("utf-8")) if target.exists() else []
    for row in rows:
        other = next((h for h in held if h["id"] == row["id"] and h["candidateId"] != row["candidateId"]), None)
        if other:
            raise ValueError(fixed.MESSAGES["promoted_before"].format(row["id"], other["candidateId"]))
        at = next((i for i, h in enumerate(held) if h["candidateId"] == row["candidateId"]), None)
        if at is None:
            held.append(row)
        else:
            held[at] = row
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(held, indent=2, ensure_ascii=False) + "\n", "utf-8")
    return len(rows)

