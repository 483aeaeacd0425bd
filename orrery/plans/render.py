"""Results for people: Markdown of a version diff, JSON reports, a question's explanation as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff

#: Rows of each status that a diff shows, in Markdown and as text (fixed values).
MOST_MARKDOWN, MOST_TEXT = 50, 20
_SHOWN = ("added", "removed", "modified")


def _listed(changes: DataFrame, status: str, most: int | None) -> list:
    rows = changes.where(F.col("status") == status).select(F.coalesce("a_name", "b_name").alias("name"), F.coalesce("a_kind", "b_kind").alias("kind"), F.coalesce("a_file_path", "b_file_path").alias("file"), "change_type").orderBy("name", "file")
    return (rows if most is None else rows.limit(most)).collect()


def diff_markdown(changes: DataFrame, from_version: str, to_version: str, most: int = MOST_MARKDOWN) -> str:
    """A diff's counts and its first rows by status."""
    counts = {r["status"]: r["n"] for r in diff.diff_stats(changes).collect()}
    lines = [f"# Changes from {from_version} to {to_version}", "", *(f"- {s}: {counts[s]}" for s in diff.STATUSES)]
    for status in _SHOWN:
        rows = _listed(changes, status, most)
        if rows:
            lines += ["", f"## {status.capitalize()}", "", "| name | kind | file | change |", "|-|-|-|-|", *(f"| {r['name']} | {r['kind']} | {r['file']} | {r['change_type'] or ''} |" for r in rows)]
            if counts[status] > len(rows):
                lines.append(f"\n... and {counts[status] - len(rows)} more")
    return "\n".join(lines)


def diff_text(changes: DataFrame, from_version: str, to_version: str, most: int = MOST_TEXT) -> str:
    """The same for a terminal."""
    counts = {r["status"]: r["n"] for r in diff.diff_stats(changes).collect()}
    lines = [f"{from_version} -> {to_version}: " + ", ".join(f"{counts[s]} {s}" for s in diff.STATUSES)]
    for sign, status in zip("+-~", _SHOWN, strict=True):
        rows = _listed(changes, status, most)
        lines += [f"  {sign} {r['name']} ({r['change_type'] if status == 'modified' else r['kind']}) {r['file']}" for r in rows]
        if counts[status] > len(rows):
            lines.append(f"  ... and {counts[status] - len(rows)} more")
    return "\n".join(lines)


def diff_json(changes: DataFrame, from_version: str, to_version: str, most: int | None = None) -> str:
    """A diff as one JSON object, for diffs that fit the driver; `most` bounds each list."""
    lists = {s: [r.asDict() for r in _listed(changes, s, most)] for s in _SHOWN}
    stats = {r["status"]: r["n"] for r in diff.diff_stats(changes).collect()}
    return json.dumps({"from": from_version, "to": to_version, "stats": stats, **lists}, ensure_ascii=False, indent=2)


def review_text(page: DataFrame, status: str, offset: int = 0) -> str:
    """A page of candidates (see `mining.review`) for a reviewer."""
    rows = page.collect()
    if not rows:
        return f"no {status} candidates here"
    lines = [f"{status}: {offset + 1} to {offset + len(rows)} of {rows[0]['total']}"]
    for r in rows:
        marks = (f" dup_of={r['dup_of']}" if r["dup_of"] else "") + (" [failed]" if r["failed_draft"] else "")
        lines += [f"  {r['id']} ({r['category']}){marks}", f"    {r['title']} [{r['canonical_id']}]", f"    aliases {', '.join(r['aliases'])}; {r['symptoms']} symptoms, {r['symbols']} symbols, {r['sources']}"]
    return "\n".join(lines)


def explanation_text(question: str, said: dict) -> str:
    lines = [f"Query: {question}", "", f"Summary: {said['summary']}", "", f"Primary Cause: {said['primary_cause']}", "", *(f"- {f}" for f in said["contributing_factors"]), "", f"Evidence: {said['evidence_summary']}", "", *(f"- {a}" for a in said["suggested_actions"]), ""]
    return "\n".join([*lines, f"Confidence: {said['confidence'] * 100:.0f}%"])


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
