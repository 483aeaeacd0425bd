"""Registered queries of packs and of the tools that assemble them, with their SQL oracles.

The oracles cut lists of costs: what an element costs is all that decides which are given up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folders
from ..operators import graph, packing, relational
from .catalog import _MATCH, _PATTERN_ROWS, _SCORED, _bm25, _patterns, _read, _values, query

# --- cutting, in SQL ------------------------------------------------------------------------------------------------

_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')"
_SIZE = "CAST(ceil(len({}) / 4) AS BIGINT)"


def _every(n: int, at: int, value: str, lines: str = "l") -> str:
    """What each n-th line costs."""
    return f"list_transform(list_filter(range(1, len({lines}) + 1), lambda i: (i - 1) % {n} = {at}), lambda i: {value.format(f'{lines}[i]')})"


def _sum(costs: str) -> str:
    return f"CAST(coalesce(list_sum({costs}), 0) AS BIGINT)"


def _json(costs: str) -> str:
    return f"CAST(ceil((1 + greatest({_sum(costs)}, 1)) / 4) AS BIGINT)"


def _prefix(costs: str, room: str) -> str:
    start = "{'s': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT)}"
    return f"list_reduce(list_transform({costs}, lambda x: {{'s': CAST(x AS BIGINT), 'n': CAST(0 AS BIGINT)}}), lambda a, x: {{'s': a.s + x.s, 'n': a.n + CAST(a.s + x.s <= {room} AS BIGINT)}}, {start}).n"


class _Cut:
    """Steps that cut columns of cost lists to a budget, as a chain of common table expressions that begins at `p0`."""

    def __init__(self, budget: str, lists: list[str], json: list[str], fixed: str = "0") -> None:
        self.budget, self.json, self.steps = budget, json, []
        self.total = " + ".join([fixed, *(self.cost(n) for n in (*lists, *json))])

    def cost(self, name: str) -> str:
        return _json(name) if name in self.json else _sum(name)

    def _add(self, name: str, new: str, changed: str) -> None:
        k = len(self.steps)
        room = f"({self.budget} - ({self.total} - {self.cost(name)}))"
        over = f"({self.total}) > {self.budget}"
        self.steps.append(f"w{k} AS (SELECT *, {over} AS over, {room} AS room FROM p{k}), n{k} AS (SELECT *, CASE WHEN over THEN {new} ELSE {name} END AS now FROM w{k}), p{k + 1} AS (SELECT * EXCLUDE (over, room, now) REPLACE (now AS {name}, cut OR {changed.format(name)} AS cut) FROM n{k})")

    def drop_last(self, name: str, least: int = 0) -> None:
        room = "4 * room - 1" if name in self.json else "room"
        self._add(name, f"list_slice({name}, 1, greatest({_prefix(name, room)}, least(len({name}), {least})))", "len(now) < len({})")

    def clear(self, name: str) -> None:
        self._add(name, f"list_slice({name}, 1, 0)", "len(now) < len({})")

    def change(self, name: str, value: str) -> None:
        """value: a new cost from the old one, `x`."""
        self._add(name, f"list_transform({name}, lambda x: CAST({value} AS BIGINT))", "now <> {}")

    def texts(self, name: str, most: int, rest: int) -> None:
        """Texts that cost x less `rest` are cut to `most` tokens and a mark of four."""
        self.change(name, f"CASE WHEN x - {rest} > {most} THEN {most + 4 + rest} ELSE x END")

    def sql(self) -> str:
        return ", ".join(self.steps)

    @property
    def last(self) -> str:
        return f"p{len(self.steps)}"


def _lines() -> Column:
    return F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")


def _each(n: int, at: int, value) -> Column:  # noqa: ANN001
    return F.transform(F.filter(_lines(), lambda x, i: i % n == at), value)


# --- context packs --------------------------------------------------------------------------------------------------


def _caps(costs: str, cap: int, overhead: int, fixed_part: int, keep_first: bool) -> str:
    """A struct of the costs that a section's cap keeps, and whether any did not fit."""
    first = "x.i = 1" if keep_first else "FALSE"
    left = f"({cap} - a.u)"
    cut = f"({left} > 100 OR {first})"
    put = f"CASE WHEN x.c <= {left} THEN list_append(a.k, x.c) WHEN {cut} THEN list_append(a.k, CASE WHEN {left} - {overhead} > 0 THEN {left} - {overhead} + 4 + {fixed_part} ELSE {fixed_part} END) ELSE a.k END"
    used = f"CASE WHEN x.c <= {left} THEN a.u + x.c WHEN {cut} THEN {cap} ELSE a.u END"
    row = lambda c, i: f"{{'c': CAST({c} AS BIGINT), 'i': CAST({i} AS BIGINT), 'u': CAST(0 AS BIGINT), 'k': []::BIGINT[], 'o': FALSE}}"
    return f"list_reduce(list_transform({costs}, lambda y, j: {row('y', 'j')}), lambda a, x: {{'c': x.c, 'i': x.i, 'u': CAST({used} AS BIGINT), 'k': {put}, 'o': a.o OR x.c > {left}}}, {row('0', '0')})"


_EDGE_CAP = _prefix("e", "1999")
_CONTEXT = _Cut("1500", ["source", "issues"], ["callgraph"], "symbol")
_CONTEXT.drop_last("source", 1)
_CONTEXT.change("source", "20 + CASE WHEN room <= 0 THEN 0 WHEN x - 20 <= room THEN x - 20 ELSE room + 4 END")
_CONTEXT.drop_last("issues")
_CONTEXT.drop_last("callgraph")
_CAPPED = f"""
WITH d AS (SELECT doc_id AS pack_id, {_LINES} AS l, regexp_split_to_array(coalesce(text, ''), '\\s+') AS t, {_SIZE.format("('{\"id\":\"' || doc_id || '\",\"name\":\"' || coalesce(source, '') || '\",\"exports\":[],\"imports\":[]}')")} AS symbol FROM documents),
c AS (SELECT pack_id, symbol, {_caps(_every(2, 0, f"{_SIZE} + 20"), 3000, 20, 20, True)} AS s, {_caps(_every(2, 1, f"{_SIZE} + 31"), 1000, 30, 31, False)} AS i, list_transform(t, lambda x: CAST(len(to_json({{'target_id': x}})) + 1 AS BIGINT)) AS e FROM d),
p0 AS (SELECT pack_id, symbol, s.k AS source, i.k AS issues, CASE WHEN {_json("e")} > 500 THEN list_slice(e, 1, {_EDGE_CAP}) ELSE e END AS callgraph, s.o OR i.o OR {_json("e")} > 500 AND {_EDGE_CAP} < len(e) AS cut FROM c)"""


@query(f"""{_CAPPED}, {_CONTEXT.sql()}
SELECT pack_id, CAST({_CONTEXT.total} AS BIGINT) AS total_tokens, cut AS truncated, ({_CONTEXT.total}) > 1500 AS unavoidable_overflow, CAST(len(source) AS INTEGER) AS sources, CAST(len(issues) AS INTEGER) AS issues, CAST(len(callgraph) AS INTEGER) AS edges FROM {_CONTEXT.last}""")
def section_caps(spark: SparkSession, sf: str) -> DataFrame:
    """A context pack for each document, its lines in turn as sources and issues and its words as edges, cut to 1,500 tokens."""
    none = F.lit(None).cast("string")
    symbol = F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("name"), none.alias("doc_comment"), none.alias("parent_class"), F.array().cast("array<string>").alias("exports"), F.array().cast("array<string>").alias("imports"))
    packs = folders.few_splits(_read(spark, sf, "documents", "doc_id", "source", "text")).select(
        F.col("doc_id").alias("pack_id"), symbol.alias("symbol"), _each(2, 0, lambda x: F.struct(x.alias("code"))).alias("source"), _each(2, 1, lambda x: F.struct(F.lit("t").alias("title"), x.alias("body"))).alias("issues"),
        F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: F.struct(x.alias("target_id"))).alias("callgraph"),
    )
    cut = packing.context_pack(packs, 1500)
    return cut.select("pack_id", "total_tokens", "truncated", "unavoidable_overflow", F.size("source").alias("sources"), F.size("issues").alias("issues"), F.size("callgraph").alias("edges"))


# --- diagnosis and skill packs --------------------------------------------------------------------------------------

_BUDGET = "(200 + doc_id % 7 * 300)"
_EDGE = "list_transform(l, lambda x: CAST(len(to_json({'target_id': substr(x, 1, 10)})) + 1 AS BIGINT))"
_DIAGNOSIS = _Cut("budget", ["related_source", "related_issues", "related_experiences", "render_stages", "fix_suggestions", "investigation_steps"], ["callgraph"])
_DIAGNOSIS.drop_last("related_source")
_DIAGNOSIS.change("related_issues", "CASE WHEN x - 31 > floor(budget / len(related_issues)) - 31 AND floor(budget / len(related_issues)) - 31 > 0 THEN floor(budget / len(related_issues)) - 31 + 4 + 31 ELSE x END")
for _name in ("related_issues", "related_experiences", "callgraph"):
    _DIAGNOSIS.drop_last(_name)
_DIAGNOSIS.texts("render_stages", 50, 11)
_DIAGNOSIS.drop_last("render_stages")
_DIAGNOSIS.texts("fix_suggestions", 40, 0)
_DIAGNOSIS.texts("investigation_steps", 40, 0)
_DIAGNOSIS.clear("fix_suggestions")
_DIAGNOSIS.clear("investigation_steps")


@query(f"""
WITH d AS (SELECT doc_id, {_BUDGET} AS budget, {_LINES} AS l FROM documents),
p0 AS (SELECT doc_id, budget, {_every(2, 0, f"{_SIZE} + 20")} AS related_source, {_every(2, 1, f"{_SIZE} + 31")} AS related_issues, list_transform(range(0, doc_id % 4), lambda i: CAST(23 AS BIGINT)) AS related_experiences, {_EDGE} AS callgraph,
{_every(5, 0, f"{_SIZE} + 11")} AS render_stages, {_every(7, 0, _SIZE)} AS fix_suggestions, {_every(6, 0, _SIZE)} AS investigation_steps, FALSE AS cut FROM d), {_DIAGNOSIS.sql()}
SELECT doc_id AS pack_id, CAST({_DIAGNOSIS.total} AS BIGINT) AS total_tokens, cut AS truncated, ({_DIAGNOSIS.total}) > budget AS unavoidable_overflow, CAST(len(related_source) AS INTEGER) AS sources, CAST(len(related_issues) AS INTEGER) AS issues,
CAST(len(callgraph) AS INTEGER) AS edges, CAST(len(render_stages) AS INTEGER) AS stages, CAST(len(fix_suggestions) + len(investigation_steps) AS INTEGER) AS advice FROM {_DIAGNOSIS.last}""")
def diagnosis_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A diagnosis pack for each document, from its lines, cut to budgets of 200 to 2,000 tokens."""
    docs = folders.few_splits(_read(spark, sf, "documents", "doc_id", "text"))
    k = F.col("doc_id")
    empty = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    seen = F.struct(F.lit("xxxx").alias("title"), F.lit("issue").alias("type"))
    packs = docs.select(
        k.alias("pack_id"), (200 + k % 7 * 300).alias("budget"), empty("id:string,name:string,possibleCauses:array<string>").alias("matched_patterns"), empty("name:string,kind:string").alias("related_symbols"),
        _each(2, 0, lambda x: F.struct(x.alias("code"))).alias("related_source"), _each(2, 1, lambda x: F.struct(F.lit("t").alias("title"), x.alias("body"))).alias("related_issues"),
        F.array_repeat(seen, (k % 4).cast("int")).alias("related_experiences"), F.transform(_lines(), lambda x: F.struct(F.substring(x, 1, 10).alias("target_id"))).alias("callgraph"),
        _each(5, 0, lambda x: F.struct(F.lit("n").alias("name"), x.alias("description"))).alias("render_stages"), _each(7, 0, lambda x: x).alias("fix_suggestions"), _each(6, 0, lambda x: x).alias("investigation_steps"),
    )
    cut = packing.diagnostic_pack(packs, F.col("budget"))
    sizes = {"sources": "related_source", "issues": "related_issues", "edges": "callgraph", "stages": "render_stages"}
    return cut.select("pack_id", "total_tokens", "truncated", "unavoidable_overflow", *[F.size(c).alias(n) for n, c in sizes.items()], (F.size("fix_suggestions") + F.size("investigation_steps")).alias("advice"))


_SKILL = _Cut("budget", ["source", "issues", "render_stages", "forum", "experience", "investigation_steps", "diagnosis_fixes", "fix_suggestions"], ["callgraph"], "21 + 15")
_SKILL.clear("experience")
_SKILL.clear("forum")
_SKILL.drop_last("callgraph")
_SKILL.drop_last("issues")
_SKILL.drop_last("source", 1)
_SKILL.texts("source", 100, 20)
_SKILL.texts("render_stages", 50, 11)
_SKILL.drop_last("render_stages")
_SKILL.clear("fix_suggestions")


@query(f"""
WITH d AS (SELECT doc_id, {_BUDGET} AS budget, {_LINES} AS l FROM documents),
p0 AS (SELECT doc_id, budget, {_every(2, 0, f"{_SIZE} + 20")} AS source, {_every(2, 1, f"{_SIZE} + 31")} AS issues, {_EDGE} AS callgraph, {_every(9, 3, f"{_SIZE} + 31")} AS forum, {_every(8, 2, f"{_SIZE} + 21")} AS experience, {_every(5, 0, f"{_SIZE} + 11")} AS render_stages,
{_every(7, 0, _SIZE)} AS fix_suggestions, {_every(6, 0, _SIZE)} AS investigation_steps, {_every(11, 5, _SIZE)} AS diagnosis_fixes, FALSE AS cut FROM d), {_SKILL.sql()},
o AS (SELECT *, ({_SKILL.total}) > budget AS over FROM {_SKILL.last}), z AS (SELECT * EXCLUDE (over) REPLACE (cut OR over AND len(investigation_steps) + len(diagnosis_fixes) > 0 AS cut, CASE WHEN over THEN [] ELSE investigation_steps END AS investigation_steps, CASE WHEN over THEN [] ELSE diagnosis_fixes END AS diagnosis_fixes) FROM o)
SELECT doc_id AS pack_id, CAST({_SKILL.total} AS BIGINT) AS total_tokens, cut AS truncated, CAST(len(source) AS INTEGER) AS sources, CAST(len(issues) AS INTEGER) AS issues, CAST(len(callgraph) AS INTEGER) AS edges, CAST(len(render_stages) AS INTEGER) AS stages,
CAST(len(forum) + len(experience) AS INTEGER) AS posts, CAST(len(fix_suggestions) + len(investigation_steps) + len(diagnosis_fixes) AS INTEGER) AS advice FROM z""")
def skill_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A skill pack for each document, from its lines, cut to budgets of 200 to 2,000 tokens."""
    k = F.col("doc_id")
    issue = lambda x: F.struct(F.lit("t").alias("title"), x.alias("body"))
    packs = folders.few_splits(_read(spark, sf, "documents", "doc_id", "text")).select(
        k.alias("pack_id"), (200 + k % 7 * 300).alias("budget"), F.lit("abc").alias("query"), F.struct(F.lit("debug").alias("skill")).alias("dispatch"), F.lit(None).cast("struct<id:string>").alias("symbol"), F.array().cast("array<struct<id:string>>").alias("matched_patterns"),
        _each(2, 0, lambda x: F.struct(x.alias("code"))).alias("source"), _each(2, 1, issue).alias("issues"), F.transform(_lines(), lambda x: F.struct(F.substring(x, 1, 10).alias("target_id"))).alias("callgraph"), _each(9, 3, issue).alias("forum"),
        _each(8, 2, lambda x: F.struct(F.lit("t").alias("title"), x.alias("summary"))).alias("experience"), _each(5, 0, lambda x: F.struct(F.lit("n").alias("name"), x.alias("description"))).alias("render_stages"),
        _each(7, 0, lambda x: x).alias("fix_suggestions"), _each(6, 0, lambda x: x).alias("investigation_steps"), _each(11, 5, lambda x: x).alias("diagnosis_fixes"),
    )
    cut = packing.skill_pack(packs, F.col("budget"))
    sizes = {"sources": "source", "issues": "issues", "edges": "callgraph", "stages": "render_stages"}
    add = lambda *names: sum((F.size(n) for n in names[1:]), F.size(names[0]))
    return cut.select("pack_id", "total_tokens", "truncated", *[F.size(c).alias(n) for n, c in sizes.items()], add("forum", "experience").alias("posts"), add("fix_suggestions", "investigation_steps", "diagnosis_fixes").alias("advice"))


# --- assembly -------------------------------------------------------------------------------------------------------

_QUESTION = "tion the thand: Der die und ing ther"
_STAGE_IDS = ["shadow", "draw", "cull", "input"]
_CODE = "'code of ' || id"
_KB_SYMBOLS = "sy AS (SELECT 's' || p_partkey AS id, p_partkey AS k, CASE p_partkey % 331 WHEN 1 THEN 'The' WHEN 2 THEN 'Der' WHEN 3 THEN 'And' ELSE 'Part' || p_partkey END AS name FROM part)"
_KB_EDGES = "ed AS (SELECT 's' || k AS f, 's' || (k * m) AS t, m FROM (SELECT k, unnest([2, 3]) AS m FROM sy) WHERE k > 0 AND k * m <= (SELECT max(k) FROM sy))"
_KB_ISSUES = "(SELECT n_nationkey AS id, 'Part' || (n_nationkey % 7) || ' und' AS title, 'the ' || n_name AS body FROM nation)"


def _knowledge(spark: SparkSession, sf: str):  # noqa: ANN202
    """An engine over a knowledge base of all parts and nations."""
    from .engine import KnowledgeEngine

    k, n = F.col("p_partkey"), F.col("n_nationkey")
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    name = F.when(k % 331 == 1, "The").when(k % 331 == 2, "Der").when(k % 331 == 3, "And").otherwise(F.concat(F.lit("Part"), k.cast("string")))
    part = _read(spark, sf, "part", "p_partkey")
    sid = lambda c: F.concat(F.lit("s"), c.cast("string"))
    symbols = part.select(sid(k).alias("id"), name.alias("name"), F.lit("function").alias("kind"), F.lit("f.js").alias("file_path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), none.alias("doc_comment"), empty.alias("exports"), empty.alias("imports"), none.alias("parent_class"))
    source = symbols.where("id <> 's15'").select(F.col("id").alias("symbol_id"), "name", F.concat(F.lit("code of "), "id").alias("code"))
    last = part.agg(F.max(k).alias("last"))
    edges = part.where(k > 0).select(k, F.explode(F.array(F.lit(2), F.lit(3))).alias("m")).crossJoin(F.broadcast(last)).where(k * F.col("m") <= F.col("last"))
    edges = edges.select(sid(k).alias("source_id"), sid(k * F.col("m")).alias("target_id"), F.lit("x").alias("source_name"), F.lit("y").alias("target_name"), F.lit("call").alias("edge_type"), F.lit(1.0).alias("weight"))
    issues = _read(spark, sf, "nation").select(n.cast("long").alias("id"), n.cast("long").alias("number"), F.concat(F.lit("Part"), (n % 7).cast("string"), F.lit(" und")).alias("title"), F.concat(F.lit("the "), "n_name").alias("body"), F.lit("open").alias("state"))
    lists = lambda c: F.create_map(*[x for i, r in enumerate(_PATTERN_ROWS) for x in (F.lit(r[0]), F.array(*map(F.lit, c(i))))])[F.col("id")]
    patterns = _patterns(spark).withColumns({
        "severity": F.lit("high"), "possibleCauses": F.array(F.lit("c")), "relatedStages": lists(lambda i: [_STAGE_IDS[i], "draw"]), "issueQueries": lists(lambda i: ["und", f"NATION_{i}"]),
        "investigationSteps": lists(lambda i: [f"step {i}", "look"]), "fixSuggestions": lists(lambda i: [f"fix {i}"]),
    })
    stages = _values(spark, [(s, s.upper(), i, "d", False) for i, s in enumerate(_STAGE_IDS)], "id string, name string, order int, description string, perfHotspot boolean").withColumn("symptomHints", empty)
    return KnowledgeEngine(spark, {"symbols": symbols, "source_code": source, "call_edges": edges, "issues": issues}, patterns, stages)


def _listed(pack: DataFrame, **sections: str) -> DataFrame:
    """(section, place, value) of a pack's sections; the order of a section that counts as a set is that of its values."""
    rows = None
    for name, value in sections.items():
        values = F.col(f"{name}.{value}" if value else name).cast("array<string>")
        some = pack.select(F.lit(name).alias("section"), F.posexplode(values).alias("place", "value"))
        rows = some if rows is None else rows.unionByName(some)
    return rows


@query(f"""
WITH {_KB_SYMBOLS}, {_KB_EDGES}, one AS (SELECT t AS id, 1 AS d FROM ed WHERE f = 's5'), two AS (SELECT DISTINCT ed.t AS id, 2 AS d FROM ed JOIN one ON ed.f = one.id WHERE ed.t NOT IN (SELECT id FROM one)),
c AS (SELECT id, d FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE id <> 's15' ORDER BY d, id LIMIT 3), i AS ({_bm25(_KB_ISSUES, "id", ["title", "body"], ["part5"], 5)})
SELECT 'source' AS section, CAST(row_number() OVER (ORDER BY d, id) - 1 AS INTEGER) AS place, {_CODE} AS value FROM (SELECT 's5' AS id, 0 AS d UNION ALL SELECT id, d FROM c)
UNION ALL SELECT 'issues', CAST(row_number() OVER (ORDER BY score, id) - 1 AS INTEGER), CAST(id AS VARCHAR) FROM i
UNION ALL SELECT 'callgraph', CAST(row_number() OVER (ORDER BY f, t) - 1 AS INTEGER), t FROM (SELECT f, t FROM ed WHERE f = 's5' UNION ALL SELECT f, t FROM ed WHERE f IN (SELECT id FROM one))""")
def context_pack_tool(spark: SparkSession, sf: str) -> DataFrame:
    """A symbol's pack: its source and that of three callees, its calls two steps deep, and issues that name it."""
    return _listed(_knowledge(spark, sf).build_context_pack("Part5", 2, 100_000), source="code", issues="number", callgraph="target_id")


_ONE_MATCH = _MATCH.replace("FROM documents", f"FROM (SELECT 'q' AS doc_id, '{_QUESTION}' AS text)")
_LISTS = ", ".join(f"('{r[0]}', ['{_STAGE_IDS[i]}', 'draw'], ['und', 'NATION_{i}'], ['step {i}', 'look'], ['fix {i}'])" for i, r in enumerate(_PATTERN_ROWS))
_FOUND = f"""{_ONE_MATCH}, m AS (SELECT *, row_number() OVER (ORDER BY score DESC, o) AS r FROM ({_SCORED})), ls(id, st, iq, steps, fixes) AS (VALUES {_LISTS}), {_KB_SYMBOLS}, {_KB_EDGES}"""


def _spread(column: str, source: str = "m JOIN ls ON ls.id = m.id") -> str:
    return f"(SELECT x, min((r, n)) AS pos FROM (SELECT r, unnest({column}) AS x, generate_subscripts({column}, 1) AS n FROM {source}) GROUP BY x)"


_ISSUE_SEARCHES = " UNION ALL ".join(
    f"SELECT '{q}' AS q, id, score FROM ({_bm25(_KB_ISSUES, 'id', ['title', 'body'], [q.lower().replace('_', ' ')], 3)})" for q in ("und", *(f"NATION_{i}" for i in range(len(_PATTERN_ROWS))))
)


@query(f"""{_FOUND}, y AS (SELECT sy.id, pos FROM {_spread("rel", "m JOIN p ON p.id = m.id")} AS z JOIN sy ON sy.name = z.x), h AS ({_ISSUE_SEARCHES}),
iss AS (SELECT id, min((pos, score)) AS pos FROM h JOIN {_spread("iq")} AS z ON z.x = h.q GROUP BY id)
SELECT 'matched_patterns' AS section, CAST(r - 1 AS INTEGER) AS place, id AS value FROM m UNION ALL SELECT 'related_symbols', CAST(row_number() OVER (ORDER BY pos, id) - 1 AS INTEGER), id FROM y
UNION ALL SELECT 'related_source', CAST(row_number() OVER (ORDER BY pos, id) - 1 AS INTEGER), {_CODE} FROM y WHERE id <> 's15' UNION ALL SELECT 'callgraph', CAST(row_number() OVER (ORDER BY f, t) - 1 AS INTEGER), t FROM ed WHERE f IN (SELECT id FROM y)
UNION ALL SELECT 'related_issues', CAST(row_number() OVER (ORDER BY pos, id) - 1 AS INTEGER), CAST(id AS VARCHAR) FROM iss
UNION ALL SELECT 'render_stages', CAST(row_number() OVER (ORDER BY list_position({_STAGE_IDS}, x)) - 1 AS INTEGER), x FROM {_spread("st")}
UNION ALL SELECT 'investigation_steps', CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER), x FROM {_spread("steps")} UNION ALL SELECT 'fix_suggestions', CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER), x FROM {_spread("fixes")}""")
def diagnosis_tool(spark: SparkSession, sf: str) -> DataFrame:
    """What a problem's patterns lead to, within a budget that holds it all."""
    pack = _knowledge(spark, sf).diagnose_problem(_QUESTION, 5, 1_000_000)
    return _listed(pack, matched_patterns="id", related_symbols="id", related_source="code", callgraph="target_id", related_issues="number", render_stages="id", investigation_steps="", fix_suggestions="")


_MANY = f"""{_MATCH}, m AS (SELECT *, query_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS r FROM ({_SCORED})), ls(id, st, iq, steps, fixes) AS (VALUES {_LISTS}), {_KB_SYMBOLS}, {_KB_EDGES}"""


def _spread_many(column: str, source: str = "m JOIN ls ON ls.id = m.id") -> str:
    return f"(SELECT doc_id, x, min((r, n)) AS pos FROM (SELECT doc_id, r, unnest({column}) AS x, generate_subscripts({column}, 1) AS n FROM {source}) GROUP BY doc_id, x)"


def _sections(pack: DataFrame, **sections: str) -> DataFrame:
    """(query_id, section, n, digest): how many values a section of each pack has, and a digest of them in their order. Packs are made once, however many sections."""
    pack, rows = folders.stored(pack, "packs"), None
    for name, value in sections.items():
        values = F.col(f"{name}.{value}" if value else name).cast("array<string>")
        some = pack.select("query_id", F.lit(name).alias("section"), F.size(values).cast("long").alias("n"), F.md5(F.array_join(values, ",")).alias("digest"))
        rows = some if rows is None else rows.unionByName(some)
    return rows


def _sections_sql(ids: str, **sections: str) -> str:
    """The same of subqueries of (id of the pack, pos, value)."""
    return " UNION ALL ".join(
        f"SELECT q.doc_id AS query_id, '{name}' AS section, count(s.value) AS n, md5(coalesce(string_agg(s.value, ',' ORDER BY s.pos, s.value), '')) AS digest FROM {ids} AS q LEFT JOIN ({rows}) AS s ON s.doc_id = q.doc_id GROUP BY q.doc_id"
        for name, rows in sections.items()
    )


_EVERY_DIAGNOSIS = _sections_sql(
    "documents",
    matched_patterns="SELECT doc_id, r AS pos, id AS value FROM m",
    related_symbols="SELECT doc_id, pos, id AS value FROM y",
    related_source=f"SELECT doc_id, pos, {_CODE} AS value FROM y WHERE id <> 's15'",
    callgraph="SELECT doc_id, (f, t) AS pos, t AS value FROM ed JOIN y ON y.id = ed.f",
    related_issues="SELECT doc_id, min((pos, score, id)) AS pos, CAST(id AS VARCHAR) AS value FROM iss GROUP BY doc_id, id",
    render_stages=f"SELECT doc_id, list_position({_STAGE_IDS}, x) AS pos, x AS value FROM {_spread_many('st')}",
    investigation_steps=f"SELECT doc_id, pos, x AS value FROM {_spread_many('steps')}",
    fix_suggestions=f"SELECT doc_id, pos, x AS value FROM {_spread_many('fixes')}",
)


@query(f"""{_MANY}, y AS (SELECT doc_id, sy.id, pos FROM {_spread_many("rel", "m JOIN p ON p.id = m.id")} AS z JOIN sy ON sy.name = z.x), h AS ({_ISSUE_SEARCHES}),
iss AS (SELECT doc_id, id, pos, score FROM h JOIN {_spread_many("iq")} AS z ON z.x = h.q) {_EVERY_DIAGNOSIS}""")
def diagnosis_many(spark: SparkSession, sf: str) -> DataFrame:
    """What every document's patterns lead to, each document being a question; documents with the same patterns share a pack, and what is told of it."""
    asked = _read(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    packs, members = _knowledge(spark, sf).diagnose_shared(folders.few_splits(asked), 5, 1_000_000)
    rows = _sections(packs, matched_patterns="id", related_symbols="id", related_source="code", callgraph="target_id", related_issues="number", render_stages="id", investigation_steps="", fix_suggestions="")
    rows = folders.stored(rows.withColumnRenamed("query_id", "pack"), "told")
    return members.select("query_id", "pack").join(relational.side(rows, rows.count() <= graph.BROADCAST_ROWS), "pack").drop("pack")


_EVERY_CONTEXT = _sections_sql(
    "q",
    source=f"SELECT doc_id, (d, id) AS pos, {_CODE} AS value FROM src",
    callgraph="SELECT doc_id, (f, t) AS pos, t AS value FROM calls",
    issues="SELECT doc_id, (score, id) AS pos, CAST(id AS VARCHAR) AS value FROM hits",
)


@query(f"""
WITH {_KB_SYMBOLS}, {_KB_EDGES}, q AS (SELECT id AS doc_id, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM sy) WHERE n = 1),
one AS (SELECT q.doc_id, f, t, 1 AS d FROM q JOIN ed ON ed.f = q.doc_id), two AS (SELECT DISTINCT one.doc_id, ed.f, ed.t, 2 AS d FROM one JOIN ed ON ed.f = one.t), calls AS (SELECT * FROM one UNION ALL SELECT * FROM two),
near AS (SELECT doc_id, t AS id, min(d) AS d FROM calls WHERE t <> 's15' GROUP BY doc_id, t),
src AS (SELECT doc_id, doc_id AS id, 0 AS d FROM q WHERE doc_id <> 's15' UNION ALL SELECT doc_id, id, d FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, id) AS n FROM near) WHERE n <= 3),
i AS (SELECT id, regexp_extract_all(lower(title || ' ' || body), '[a-z0-9]+') AS w FROM {_KB_ISSUES}), g AS (SELECT count(*) AS n, avg(len(w)) AS a FROM i),
tf AS (SELECT id, len(w) AS dl, x, count(*) AS c FROM (SELECT id, w, unnest(w) AS x FROM i) GROUP BY ALL), df AS (SELECT x, count(*) AS df FROM tf GROUP BY x),
hit AS (SELECT q.doc_id, tf.id, -(CASE WHEN ln((g.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((g.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / g.a)) AS score FROM q JOIN tf ON tf.x = lower(q.name) JOIN df USING (x), g),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, id) AS n FROM hit) WHERE n <= 5) {_EVERY_CONTEXT}""")
def context_packs_many(spark: SparkSession, sf: str) -> DataFrame:
    """The pack of every part's name: source of the part and its nearest callees that have source, calls two steps deep, issues that name it."""
    engine = _knowledge(spark, sf)
    packs = engine.build_context_packs(folders.few_splits(engine.tables["symbols"].select(F.col("name").alias("query")).distinct()), 2, 100_000)
    return _sections(packs.withColumn("query_id", F.col("symbol.id")), source="code", callgraph="target_id", issues="number")


@query(f"""{_FOUND}, i AS ({_bm25(_KB_ISSUES, "id", ["title", "body"], ["the"], 5)})
SELECT 'source' AS section, 0 AS place, 'code of s1' AS value UNION ALL SELECT 'callgraph', CAST(row_number() OVER (ORDER BY f, t) - 1 AS INTEGER), t FROM ed WHERE f = 's1'
UNION ALL SELECT 'issues', CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER), CAST(id AS VARCHAR) FROM i UNION ALL SELECT 'matched_patterns', CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER), id FROM m WHERE r <= 3
UNION ALL SELECT 'render_stages', CAST(row_number() OVER (ORDER BY list_position({_STAGE_IDS}, x)) - 1 AS INTEGER), x FROM {_spread("st")}""".replace(_QUESTION, f"bug in The.x {_QUESTION}"))
def skill_pack_tool(spark: SparkSession, sf: str) -> DataFrame:
    """What a question's skill asks for, about the symbol it names."""
    engine = _knowledge(spark, sf)
    pack = engine.build_skill_pack(f"bug in The.x {_QUESTION}", 1_000_000)
    return _listed(pack, source="code", callgraph="target_id", issues="number", matched_patterns="id", render_stages="id")


@query(f"""
{_FOUND}, one AS (SELECT t AS id FROM ed WHERE f = 's5'), i AS ({_bm25("(SELECT n_nationkey AS id, 'Part' || (n_nationkey % 7) || ' und' AS title, 'the ' || n_name AS body, n_nationkey % 10 / 10 AS quality FROM nation)", "id", ["title", "body"], ["part3"], 10, "quality >= 0.5")})
SELECT 'get_source' AS tool, 'code of s4' AS value UNION ALL SELECT 'trace_callgraph', f || '>' || t FROM ed WHERE f = 's5' OR f IN (SELECT id FROM one) UNION ALL SELECT 'trace_callgraph up', f || '>' || t FROM ed WHERE t = 's60'
UNION ALL SELECT 'query_render_stage', unnest(['shadow', 'draw']) UNION ALL SELECT 'dispatch_skill', 'debug' UNION ALL SELECT 'search_symbol', 's5' UNION ALL SELECT 'search_forum', CAST(id AS VARCHAR) FROM i
UNION ALL SELECT 'search_shader', 'shader/' || k FROM sy WHERE k % 4 = 2 AND name LIKE 'Part%' UNION ALL SELECT 'diagnose_root_cause', 'Known problem ' || id FROM m WHERE r = 1""")
def tool_results(spark: SparkSession, sf: str) -> DataFrame:
    """What other tools answer over the small knowledge base."""
    from .engine import KnowledgeEngine

    base = _knowledge(spark, sf)
    k, n = F.col("p_partkey"), F.col("n_nationkey")
    shaders = base.tables["symbols"].select(F.concat(F.lit("shader/"), F.substring("id", 2, 9)).alias("id"), F.upper("name").alias("name"), F.lit("uniform").alias("type"), F.lit("f").alias("file"), F.when(F.substring("id", 2, 9).cast("int") % 4 == 2, "globe").otherwise("pick").alias("related_render_stage"), F.array().cast("array<string>").alias("related_js_symbols"))
    posts = _read(spark, sf, "nation").select(n.cast("long").alias("id"), F.concat(F.lit("Part"), (n % 7).cast("string"), F.lit(" und")).alias("title"), F.concat(F.lit("the "), "n_name").alias("body"), ((n % 10) / 10).alias("quality_score"))
    engine = KnowledgeEngine(spark, base.tables | {"shader_symbol": shaders, "forum_posts": posts}, base.patterns, base.stages)
    edge = F.concat_ws(">", "source_id", "target_id")
    answers = {
        "get_source": engine.get_source("s4").select("code"), "trace_callgraph": engine.trace_callgraph("Part5", "down", 2).select(edge), "trace_callgraph up": engine.trace_callgraph("Part60", "up", 1).select(edge),
        "query_render_stage": engine.query_render_stage(problem="p1").select("id"), "dispatch_skill": engine.dispatch_skill("a bug, it will flicker").select("skill"), "search_symbol": engine.search_symbol("Part5").select("id"),
        "search_forum": engine.search_forum("part3", 10, 0.5).select(F.col("id").cast("string")), "search_shader": engine.search_shader("part", "uniform", stage="globe").select("id"), "diagnose_root_cause": engine.diagnose_root_cause(_QUESTION).select("primary_cause"),
    }
    out = None
    for tool, rows in answers.items():
        named = rows.toDF("value").select(F.lit(tool).alias("tool"), "value")
        out = named if out is None else out.unionByName(named)
    return out
