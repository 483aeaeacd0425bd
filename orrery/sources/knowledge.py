"""Knowledge files: patterns, stages and skills as JSON lists, read by explicit schemas and checked."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

DATA = Path(__file__).resolve().parents[1] / "knowledge"
_REQUIRED = ("triggerKeywords", "symptoms", "possibleCauses", "relatedSymbols", "relatedStages", "investigationSteps", "fixSuggestions")


class KnowledgeError(ValueError):
    """All that is wrong with a knowledge file."""


def _ids(rows: list[dict], what: str) -> list[str]:
    errors, seen = [], set()
    for r in rows:
        name = r.get("id") or ""
        if not name.strip():
            errors.append(f"{what} has empty id")
        elif name in seen:
            errors.append(f"Duplicate {what} id: {name}")
        seen.add(name)
    return errors


def check_patterns(rows: list[dict]) -> list[str]:
    return _ids(rows, "ProblemPattern") + [f'ProblemPattern "{r.get("id")}": {f} must not be empty' for r in rows for f in _REQUIRED if not r.get(f)]


def check_stages(rows: list[dict]) -> list[str]:
    known = {r.get("id") for r in rows}
    errors = _ids(rows, "RenderStage") + [f'RenderStage "{r.get("id")}": name must not be empty' for r in rows if not (r.get("name") or "").strip()]
    return errors + [f'RenderStage "{r["id"]}": dependsOn references unknown stage "{d}"' for r in rows for d in r.get("dependsOn") or [] if d not in known]


def check_skills(rows: list[dict]) -> list[str]:
    errors = _ids(rows, "SkillConfig") + [f'SkillConfig "{r.get("id")}": tokenBudget must be positive' for r in rows if (r.get("tokenBudget") or 0) <= 0]
    return errors + ([] if any(r.get("id") == "general" for r in rows) else ['A "general" fallback skill must be defined'])


def errors(rows: DataFrame, required: Sequence[str] = (), references: str | None = None) -> DataFrame:
    """(id, error, n) for knowledge tables of any size: empty and repeated ids, required lists that are empty, references to ids that
    are not there."""
    named = F.trim(F.coalesce("id", F.lit(""))) != ""
    count = lambda frame, said, *more: frame.groupBy("id", *more).agg(F.count(F.lit(1)).alias("n")).select("id", said.alias("error"), "n")
    out = count(rows.where(~named), F.lit("empty id"))
    out = out.unionByName(count(rows.where(named), F.lit("duplicate id")).where("n > 1").withColumn("n", F.col("n") - 1))
    for name in required:
        out = out.unionByName(count(rows.where(F.size(F.coalesce(name, F.array().cast("array<string>"))) == 0), F.lit(f"{name} must not be empty")))
    if references is not None:
        refs = rows.select("id", F.explode(references).alias("__to"))
        unknown = refs.join(rows.select(F.col("id").alias("__to")).distinct(), "__to", "left_anti")
        out = out.unionByName(count(unknown, F.concat(F.lit("unknown reference "), "__to"), "__to"))
    return out


def _load(spark: SparkSession, path: str | Path, schema: T.StructType, check) -> DataFrame:  # noqa: ANN001
    rows = json.loads(Path(path).read_text("utf-8"))
    if not isinstance(rows, list):
        raise KnowledgeError(f"expected a list at {path}")
    if errors := check(rows):
        raise KnowledgeError("\n".join(errors))
    numbered = T.StructType([*schema.fields, T.StructField("ordinal", T.IntegerType())])

    def shaped(row: dict, fields: list[T.StructField]) -> tuple:
        return tuple(shaped(row.get(f.name) or {}, f.dataType.fields) if isinstance(f.dataType, T.StructType) else row.get(f.name, [] if isinstance(f.dataType, T.ArrayType) else None) for f in fields)

    return spark.createDataFrame([(*shaped(r, schema.fields), i) for i, r in enumerate(rows)], numbered)


def patterns(spark: SparkSession, path: str | Path | None = None) -> DataFrame:
    return _load(spark, path or DATA / "patterns.json", schemas.PATTERNS, check_patterns)


def stages(spark: SparkSession, path: str | Path | None = None) -> DataFrame:
    return _load(spark, path or DATA / "stages.json", schemas.STAGES, check_stages)


def skills(spark: SparkSession, path: str | Path | None = None) -> DataFrame:
    return _load(spark, path or DATA / "skills.json", schemas.SKILLS, check_skills)


def generated(spark: SparkSession, path: str | Path) -> DataFrame:
    """Generated patterns; none where the file is missing."""
    if not Path(path).exists():
        return spark.createDataFrame([], schemas.GENERATED_PATTERNS)
    return _load(spark, path, schemas.GENERATED_PATTERNS, lambda rows: [])
