"""Issue, pull-request and forum feeds: REST pulls page by page, and mappers from their JSON to the engine's tables.

A pull runs on the driver (it is bound by the service's rate limit, not by computing) and hands over raw JSON lines; everything
after that is declarative. A page is committed as soon as it has been read, so a rate limit loses nothing that came before it.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching

#: What fetches a URL: (status, headers by lower-case name, body).
Fetch = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]

_LABELS = "array<string>"
ISSUE_JSON = f"id long, number long, title string, body string, state string, labels {_LABELS}, assignees array<struct<login:string>>, user struct<login:string>, comments int, created_at string, updated_at string, closed_at string, html_url string, pull_request string"
PULL_JSON = f"id long, number long, title string, body string, state string, merged_at string, user struct<login:string>, labels {_LABELS}, review_comments int, changed_files int, created_at string, updated_at string, html_url string"
TOPIC_JSON = "id long, title string, slug string, posts_count int, views int, has_accepted_answer boolean, tags array<string>, created_at string, last_posted_at string, detail struct<post_stream:struct<posts:array<struct<cooked:string,username:string>>>>"


class RateLimitError(RuntimeError):
    """The service asks to wait until `reset_at` (seconds since 1970)."""

    def __init__(self, reset_at: float, remaining: int) -> None:
        super().__init__(f"rate limit exceeded, resets in {max(0, -(-(reset_at - time.time()) // 60)):.0f} minutes")
        self.reset_at, self.remaining = reset_at, remaining


class ApiError(RuntimeError):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(f"API error ({status}): {message}")
        self.status = status


def http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, headers=headers)
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def fetch_json(url: str, token: str | None = None, fetch: Fetch = http) -> tuple[Any, dict[str, str]]:
    headers = {"Accept": "application/vnd.github+json", "User-Agent": "orrery", "X-GitHub-Api-Version": "2022-11-28"} | ({"Authorization": f"Bearer {token}"} if token else {})
    status, answer, body = fetch(url, headers)
    if status in (403, 429):
        raise RateLimitError(float(answer.get("x-ratelimit-reset") or time.time() + 3600), int(answer.get("x-ratelimit-remaining") or 0))
    if not 200 <= status < 300:
        raise ApiError(status, body.decode("utf-8", "replace")[:200])
    return json.loads(body), answer


def next_link(header: str | None) -> str | None:
    found = re.search(r'<([^>]+)>;\s*rel="next"', header or "")
    return found.group(1) if found else None


def pages(owner: str, repo: str, kind: str, since: str | None = None, token: str | None = None, most: int | None = None, fetch: Fetch = http, base: str = "https://api.github.com") -> Iterator[list[dict]]:
    """Pages of issues (or pulls), oldest change first."""
    query = {"state": "all", "per_page": "100", "sort": "updated", "direction": "asc"} | ({"since": since} if since else {})
    url: str | None = f"{base}/repos/{owner}/{repo}/{kind}?{urllib.parse.urlencode(query)}"
    n = 0
    while url and (most is None or n < most):
        rows, headers = fetch_json(url, token, fetch)
        n += 1
        yield rows
        url = next_link(headers.get("link"))


def _plain_labels(item: dict) -> dict:
    return item | {"labels": [x if isinstance(x, str) else x.get("name") for x in item.get("labels") or []]}


def _rows(spark: SparkSession, items: list[dict], schema: str) -> DataFrame:
    lines = spark.createDataFrame([(json.dumps(_plain_labels(i) if "labels" in i else i),) for i in items], "value string")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def issue_rows(spark: SparkSession, items: list[dict], repo: str) -> DataFrame:
    """Rows of the issues table; pull requests among them are dropped."""
    items = [i | {"pull_request": json.dumps(i["pull_request"])} if i.get("pull_request") else i for i in items]
    raw = _rows(spark, items, ISSUE_JSON).where("pull_request is null")
    empty = F.lit("")
    return raw.select("id", F.lit(repo).alias("repo"), "number", "title", F.coalesce("body", empty).alias("body"), "state", "labels", F.transform(F.coalesce("assignees", F.array().cast("array<struct<login:string>>")), lambda a: a["login"]).alias("assignees"), F.coalesce("user.login", empty).alias("author"), "comments", "created_at", "updated_at", "closed_at", "html_url")


def pull_rows(spark: SparkSession, items: list[dict], repo: str) -> DataFrame:
    """Rows of merged pull requests, with the issues that their texts close."""
    raw = _rows(spark, items, PULL_JSON).where("merged_at is not null")
    return raw.select("id", F.lit(repo).alias("repo"), "number", "title", F.coalesce("body", F.lit("")).alias("body"), "state", "merged_at", F.coalesce("user.login", F.lit("")).alias("author"), "labels", "review_comments", F.col("changed_files").alias("files_changed"), "created_at", "updated_at", "html_url", text.closing_references("body").alias("closing_issue_refs"))


def topic_rows(spark: SparkSession, topics: list[dict], base: str, least_replies: int = 2, least_views: int = 200) -> DataFrame:
    """Rows of forum topics that enough people answered or saw."""
    raw = _rows(spark, topics, TOPIC_JSON)
    replies = F.greatest(F.lit(0), F.coalesce("posts_count", F.lit(1)) - 1)
    views = F.coalesce("views", F.lit(0))
    first = F.get("detail.post_stream.posts", F.lit(0))
    solved = F.coalesce("has_accepted_answer", F.lit(False))
    empty = F.lit("")
    kept = raw.where(~((replies < least_replies) & (views < least_views)))
    return kept.select("id", F.col("id").alias("topic_id"), "title", F.coalesce(text.strip_html(first["cooked"]), empty).alias("body"), F.coalesce(first["username"], empty).alias("author"), replies.alias("replies_count"), views.alias("views_count"), solved.alias("has_solution"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("created_at", empty).alias("created_at"), F.coalesce("last_posted_at", "created_at", empty).alias("updated_at"), F.concat(F.lit(base + "/t/"), "slug", F.lit("/"), F.col("id").cast("string")).alias("url"), matching.forum_quality(solved, views).alias("quality_score"))


def forum_pages(base: str, most: int = 10, fetch: Fetch = http) -> Iterator[list[dict]]:
    """Pages of topics with their first posts, until one is empty or fails."""
    for page in range(most):
        status, _, body = fetch(f"{base}/latest.json?page={page}", {"Accept": "application/json"})
        topics = (json.loads(body).get("topic_list") or {}).get("topics") or [] if 200 <= status < 300 else []
        if not topics:
            return
        for topic in topics:
            status, _, body = fetch(f"{base}/t/{topic['id']}.json", {"Accept": "application/json"})
            topic["detail"] = json.loads(body) if 200 <= status < 300 else None
        yield topics


def cursor(frame: DataFrame) -> str | None:
    """The latest change, compared as text."""
    return frame.agg(F.max("updated_at")).first()[0]
