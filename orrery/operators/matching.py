"""Rule engines over free text: problem patterns, entities, skills, intents, qualities.

Knowledge tables are small by nature and are sent to every executor once their size is checked; questions are rows, so one job
answers any number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, folders, text
from . import graph, phrases, relational

#: Bytes, as JSON, up to which a knowledge table is sent to every executor.
KNOWLEDGE_BYTES = 16 << 20


def small(frame: DataFrame, most: int = KNOWLEDGE_BYTES) -> bool:
    """Whether the frame has few enough bytes to be sent to every executor. Looks at no more rows than that takes."""
    sized = frame.select(F.octet_length(F.to_json(F.struct(*frame.columns))).alias("n")).limit(most // 16)
    row = sized.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return (row["n"] or 0) <= most and row["rows"] < most // 16


def _padded(tokens: Column) -> Column:
    """Tokens as one text in which each stands between two spaces, so that a run of tokens is a part of the text."""
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _named(kind: str) -> Callable[[Column], Column]:
    """By what a pattern matched: its kind and itself."""
    return lambda x: F.concat(F.lit(f"{kind}:"), x)


def _strong_pairs(asked: DataFrame, patterns: DataFrame, query: str) -> DataFrame:
    """(query, __place) of the questions and patterns that match by an alias, a keyword or two tokens of a symptom.

    All aliases, keywords and symptoms' tokens are sought in the padded questions in one pass; what is found is joined to the patterns that say so.
    """
    ways = lambda kind, lists: patterns.select("__place", F.lit(kind).alias("kind"), F.posexplode(lists).alias("n", "tokens"))
    uses = ways("alias", F.col("__aliases")).unionByName(ways("keyword", F.transform("__keywords", lambda k: F.array(k)))).where(F.size("tokens") > 0).select("__place", "kind", "n", _padded(F.col("tokens")).alias("phrase"))
    tokens = ways("symptom", F.col("__symptoms")).select("__place", "kind", "n", F.explode("tokens").alias("token"))
    uses = uses.unionByName(tokens.select("__place", "kind", "n", _padded(F.array("token")).alias("phrase")))
    found = phrases.held(asked, uses, query, "__text").join(uses, "phrase")
    strong = found.groupBy(query, "__place", "kind", "n").agg(F.count(F.lit(1)).alias("hits")).where("kind <> 'symptom' or hits >= 2")
    return strong.select(query, "__place").distinct()


def match_patterns(queries: DataFrame, patterns: DataFrame, limit: int | None = None, vector_scores: DataFrame | None = None, query: str = "query_id", question: str = "question", most_bytes: int = KNOWLEDGE_BYTES) -> DataFrame:
    """(query, pattern columns, score, vector_score, matched): patterns that match a question strongly, best first.

    An alias counts if its tokens stand in a row, a keyword if it is a token, a symptom if two of its tokens occur; these, or a
    vector score of `fixed.STRONG_VECTOR`, make a match strong. Symbols and the category only add. `matched` says by what.

    Patterns of up to `most_bytes` meet every question on the executors. Beyond that, a question meets only the patterns that an automaton
    over all their phrases finds it to match strongly, or that its vector is near to.

    Null and empty questions match nothing; null lists of a pattern count as empty ones; ties of the score go by the patterns'
    `ordinal` (or the order they come in); ids of questions must be unique, else a question's rows are ranked together.
    """
    asked = queries.select(query, text.query_tokens(question).alias("__tokens"))
    asked = asked.withColumn("__text", _padded(F.col("__tokens")))
    order = F.col("ordinal") if "ordinal" in patterns.columns else F.monotonically_increasing_id()
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "symptoms", "triggerKeywords", "relatedSymbols")}
    # what does not depend on the question is worked out once for each pattern
    plain = lambda c: F.filter(F.transform(c, F.lower), lambda k: ~k.rlike(r"\s") & (k != ""))
    parts = {"__aliases": F.transform("aliases", text.phrase_tokens), "__symptoms": F.transform("symptoms", text.phrase_tokens), "__keywords": plain("triggerKeywords")}
    held = patterns.withColumn("__place", order).withColumns(lists).withColumns(parts)
    scores = None if vector_scores is None else vector_scores.select(F.col(query), F.col("id"), F.col("vector_score"))
    if small(patterns, most_bytes):
        pairs = asked.join(F.broadcast(held), F.lit(True))
    else:
        asked = folders.stored(asked, "asked")  # tokens are worked out once, not for the automaton and again for the join
        near = _strong_pairs(asked, held, query)
        if scores is not None:
            near = near.union(scores.where(F.col("vector_score") >= fixed.STRONG_VECTOR).join(held.select("id", "__place"), "id").select(query, "__place"))
        pairs = near.distinct().join(asked, query).join(held, "__place")
    if scores is not None:
        pairs = pairs.join(scores, [query, "id"], "left")
    else:
        pairs = pairs.withColumn("vector_score", F.lit(None).cast("double"))
    v = F.coalesce("vector_score", F.lit(0.0))
    w = fixed.MATCH_WEIGHTS
    has = lambda token: F.contains(F.col("__text"), F.concat(F.lit(" "), token, F.lit(" ")))
    one = lambda token: has(F.lower(token)) & ~token.rlike(r"\s") & (token != "")
    overlap = lambda words: F.size(F.filter(words, has))
    pairs = pairs.withColumns({
        "__alias": F.filter("aliases", lambda x, i: (F.size(F.get("__aliases", i)) > 0) & F.contains(F.col("__text"), _padded(F.get("__aliases", i)))),
        "__keyword": F.filter("triggerKeywords", one),
        "__symptom": F.array_distinct(F.filter("symptoms", lambda x, i: overlap(F.get("__symptoms", i)) >= 2)),
        "__symbol": F.filter("relatedSymbols", one),
        "__category": F.filter(F.array("category"), one),
    })
    count = lambda c: F.size(f"__{c}").cast("double") * w[c]
    score = sum((count(c) for c in ("alias", "keyword", "symptom", "symbol", "category")), F.lit(0.0)) + F.when(v > 0, v * w["vector"]).otherwise(F.lit(0.0))
    strong = (F.size("__alias") + F.size("__keyword") + F.size("__symptom") > 0) | (v >= fixed.STRONG_VECTOR)
    named = [F.transform(f"__{c}", _named(c)) for c in ("alias", "keyword", "symptom", "symbol", "category")]
    vector = F.when(v >= fixed.STRONG_VECTOR, F.array(F.format_string("vector:%.3f", v))).otherwise(F.array().cast("array<string>"))
    out = pairs.withColumns({"score": score, "matched": F.concat(*named, vector)}).where((F.col("score") > 0) & strong)
    if limit is not None and limit > 0:
        rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "__place"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= limit)
    return out.drop("__tokens", "__text", "__place", *parts, *(f"__{c}" for c in ("alias", "keyword", "symptom", "symbol", "category")))


#: Tasks that the questions of one name are dealt over, and how many of them meet a name's symbols together.
_DEALS, _BLOCK = 32, 512


def related_symbols(found: DataFrame, symbols: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, at, symbol columns): symbols that matched patterns name, each once for a question, where the best pattern names it.

    found: matches with score, ordinal and relatedSymbols. `at` orders a question's symbols: score (negative), the pattern's place, the
    place in its list.

    A name that very many questions and symbols have is dealt by blocks of questions over `_DEALS` tasks, which hold the name's symbols; what a block and a symbol
    make leaves together, as the same questions over and over, of which files take little room. Only symbols whose id stands in several rows can come
    twice to a question; those alone are ranked, so what is joined leaves without another shuffle.
    """
    listed = found.select(query, F.struct((-F.col("score")).alias("s"), "ordinal").alias("o"), F.posexplode("relatedSymbols").alias("n", "__name"))
    named = folders.stored(listed.groupBy(query, "__name").agg(F.min(F.struct("o", "n")).alias("at")), "named")
    names = named.select(F.col("__name").alias("name")).distinct()
    names = relational.side(names, names.count() <= graph.BROADCAST_ROWS)  # few: symbols of other names are not exchanged
    wanted = folders.stored(symbols.join(names, "name", "left_semi").select(*symbols.columns), "wanted")
    several = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").select("id")
    block = F.pmod(F.xxhash64(query), F.lit(max(_DEALS, -(-named.count() // _BLOCK))))
    blocks = named.withColumn("__block", block).groupBy("__name", "__block").agg(F.collect_list(F.struct(query, "at")).alias("__asked")).withColumn("__deal", F.col("__block") % _DEALS)
    dealt = lambda rows: rows.withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALS - 1).cast("long")))).withColumnRenamed("name", "__name")
    meet = lambda rows: blocks.repartition(_DEALS, "__name", "__deal").join(dealt(rows).hint("shuffle_hash"), ["__name", "__deal"]).withColumnRenamed("__name", "name").select(F.inline("__asked"), *symbols.columns)
    first = F.row_number().over(Window.partitionBy(query, "id").orderBy("at"))
    again = meet(wanted.join(several, "id", "left_semi")).withColumn("__r", first).where("__r = 1").drop("__r")
    return meet(wanted.join(several, "id", "left_anti")).unionByName(again)


def ordered_union(found: DataFrame, column: str, query: str = "query_id") -> DataFrame:
    """(query, values): the values of a list column of a question's matches, best match first, each where it came first."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ordinal", F.col(column).alias("v"))))
    return found.groupBy(query).agg(rows.alias("r")).select(query, F.array_distinct(F.flatten(F.transform("r", lambda x: x["v"]))).alias("values"))


def coverage(issues: DataFrame, patterns: DataFrame, least: float, key: str = "id", most_chars: int | None = 4000) -> DataFrame:
    """Hits of each pattern over issues (title and body, so many characters, or all), an issue's best three of at least `least` counting."""
    question = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))
    question = question if most_chars is None else F.substring(question, 1, most_chars)
    asked = issues.select(F.col(key).alias("query_id"), question.alias("question"))
    hits = match_patterns(asked, patterns, 3).where(F.col("score") >= least)
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("hits"))


def entities(queries: DataFrame, stages: DataFrame | None = None, patterns: DataFrame | None = None, symbols: DataFrame | None = None, query: str = "query_id", question: str = "question") -> DataFrame:
    """(query, type, value, position): versions, stages, problems and symbols that a question names, each once, in that order."""
    q = F.col(question)
    base = queries.select(query, q)
    lists = lambda kind, found: base.select(query, F.lit(kind).alias("type"), F.posexplode(found).alias("n", "value"))
    parts = [lists("version", F.regexp_extract_all(q, F.lit(text.VERSION), 0)).withColumn("g", F.lit(0))]
    if stages is not None:
        named = F.contains(F.lower(q), F.lower("name")) | F.exists("symptomHints", lambda h: F.contains(F.lower(q), F.lower(h)))
        if not small(stages):
            raise ValueError("stages are a knowledge table: they must be small")
        parts.append(base.join(F.broadcast(stages), named).select(query, F.lit("stage").alias("type"), F.col("order").alias("n"), F.col("id").alias("value"), F.lit(1).alias("g")))
    if patterns is not None:
        best = match_patterns(queries, patterns, 3, query=query, question=question)
        parts.append(best.select(query, F.lit("problem").alias("type"), F.col("rank").alias("n"), F.col("id").alias("value"), F.lit(2).alias("g")))
    parts.append(lists("symbol", F.transform(F.regexp_extract_all(q, F.lit(text.DOTTED), 0), lambda x: F.split_part(x, F.lit("."), F.lit(1)))).withColumn("g", F.lit(3)))
    if symbols is not None:
        plain = lists("symbol", F.regexp_extract_all(q, F.lit(text.CAMEL_CASE), 0)).withColumn("g", F.lit(4))
        parts.append(plain.join(symbols.select(F.col("name").alias("value")).distinct(), "value", "left_semi").select(query, "type", "n", "value", "g"))
    every = reduce(DataFrame.unionByName, [p.select(query, "type", "value", "g", F.col("n").cast("int").alias("n")) for p in parts])
    once = every.groupBy(query, "type", "value").agg(F.min(F.struct("g", "n")).alias("at"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("at", "value"))
    return once.select(query, "type", "value", place.alias("position"))


def dispatch(queries: DataFrame, skills: DataFrame, found: DataFrame, query: str = "query_id", question: str = "question") -> DataFrame:
    """(query, skill, confidence, score, matched): the skill whose trigger words and entities a question has most of.

    skills has ordinal; found are the questions' entities. A problem speaks twice for `debug`, a stage for `performance` and
    `shader`, a symbol for `api`. `general` is chosen only if nothing speaks for another.
    """
    types = found.groupBy(query).agg(*[F.count_if(F.col("type") == t).alias(f"__{t}") for t in ("problem", "stage", "symbol")], F.count(F.lit(1)).alias("__entities"))
    asked = queries.select(query, question).join(types, query, "left").fillna(0)
    words = F.size(F.filter(F.split(F.lower(question), r"[\s_\-.,;:!?]+"), lambda t: t != ""))
    if not small(skills):
        raise ValueError("skills are a knowledge table: they must be small")
    pairs = asked.withColumn("__words", words).join(F.broadcast(skills), F.lit(True))
    hits = F.filter("triggerKeywords", lambda k: F.contains(F.lower(F.col(question)), F.lower(k)))
    extra = F.when(F.col("id") == "debug", 2 * F.col("__problem")).when(F.col("id").isin("performance", "shader"), F.col("__stage")).when(F.col("id") == "api", F.col("__symbol")).otherwise(F.lit(0))
    scored = pairs.withColumns({"matched": hits, "score": F.size(hits) + extra})
    effective = F.when(F.col("id") == "general", F.lit(0)).otherwise(F.col("score"))
    order = [F.desc("__effective"), F.when(F.col("__effective") == 0, F.col("id") != "general").otherwise(F.lit(False)), "ordinal"]
    best = scored.withColumn("__effective", effective).withColumn("__rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where("__rank = 1")
    total = F.col("__words") + F.col("__entities")
    confidence = F.when(total > 0, F.least(F.col("__effective") / total, F.lit(1.0))).otherwise(F.lit(0.0))
    return best.select(query, F.when(F.col("__effective") > 0, F.col("id")).otherwise(F.lit("general")).alias("skill"), text.round_half_up(confidence, 2).alias("confidence"), F.col("__effective").cast("long").alias("score"), "matched")


def intents(issues: DataFrame, title: str = "title", body: str = "body", labels: str | None = "labels", label_rules: Sequence[tuple] = fixed.LABEL_RULES, keyword_rules: Sequence[tuple] = fixed.KEYWORD_RULES) -> DataFrame:
    """``issues`` with intent, confidence, method and reason: by the first label rule that holds, else by most keywords, else unknown."""
    content = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))
    out = issues.withColumn("__text", content)
    for intent, _, words in keyword_rules:
        held = [F.when(F.contains(F.col("__text"), F.lit(w)), F.lit(w)) for w in words]
        out = out.withColumn(f"__{intent}", F.array_compact(F.array(*held)))
    counts = [F.size(f"__{i}") for i, _, _ in keyword_rules]
    best = F.greatest(*counts)
    intent = confidence = reason = F.lit(None)
    for (name, weight, _), n in reversed(list(zip(keyword_rules, counts, strict=True))):
        first = (n == best) & (best > 0)
        intent = F.when(first, F.lit(name)).otherwise(intent)
        confidence = F.when(first, F.least(F.lit(0.95), 0.5 + weight * F.least(n, F.lit(5)) / 5)).otherwise(confidence)
        reason = F.when(first, F.concat(F.lit(fixed.MESSAGES["keywords"]), F.array_join(F.slice(f"__{name}", 1, 3), ", "))).otherwise(reason)
    if labels is not None:
        low = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))
        for label, name, sure in reversed(label_rules):
            held = F.array_contains(low, label)
            intent, confidence = F.when(held, F.lit(name)).otherwise(intent), F.when(held, F.lit(sure)).otherwise(confidence)
            reason = F.when(held, F.lit(f'Label "{label}" matches')).otherwise(reason)
    return out.withColumns({
        "intent": F.coalesce(intent, F.lit("unknown")), "confidence": F.coalesce(confidence, F.lit(0.1)), "method": F.lit("rule"),
        "reason": F.coalesce(reason, F.lit(fixed.MESSAGES["nothing"])),
    }).drop("__text", *(f"__{i}" for i, _, _ in keyword_rules))


def forum_quality(solved: str | Column, views: str | Column) -> Column:
    s = F.col(solved) if isinstance(solved, str) else solved
    v = F.col(views) if isinstance(views, str) else views
    return text.round_half_up(F.when(s, F.lit(0.9)).otherwise(F.lit(0.0)) + F.least(v / 1000.0, F.lit(0.1)), 3)


def grade(confidence: str | Column) -> Column:
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c >= 0.9, "A").when(c >= 0.7, "B").when(c >= 0.5, "C").when(c >= 0.3, "D").otherwise("F")


def experience_nodes(issues: DataFrame, pulls: DataFrame, posts: DataFrame) -> DataFrame:
    """Nodes of closed issues, merged pull requests and forum posts, with summaries, mentioned symbols and qualities."""
    mentions = lambda: text.symbol_mentions(F.concat_ws(" ", "title", "body"))
    common = lambda kind: {"id": F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")), "type": F.lit(kind), "summary": text.summary(F.coalesce("body", F.lit("")))}

    def pick(frame: DataFrame, kind: str, url: str, source: Column, symbols: Column, tags: Column, quality: Column, at: str) -> DataFrame:
        new = common(kind)
        return frame.select(new["id"].alias("id"), new["type"].alias("type"), "title", F.col(url).alias("url"), source.alias("source"), new["summary"].alias("summary"), symbols.alias("related_symbols"), tags.alias("tags"), quality.alias("quality_score"), F.col(at).alias("published_at"))

    empty = F.array().cast("array<string>")
    a = pick(issues.where("state = 'closed'"), "issue", "html_url", F.col("repo"), mentions(), F.coalesce("labels", empty), F.when(F.col("comments") > 5, 0.7).otherwise(0.5), "created_at")
    closed = F.transform(F.coalesce("closing_issue_refs", F.array().cast("array<bigint>")), lambda x: x.cast("string"))
    b = pick(pulls.where("state = 'closed' and merged_at is not null"), "pr_review", "html_url", F.col("repo"), F.array_distinct(F.concat(mentions(), closed)), F.coalesce("labels", empty), F.when(F.col("review_comments") > 3, 0.8).otherwise(0.6), "created_at")
    c = pick(posts, "forum", "url", F.lit("forum"), mentions(), F.coalesce("tags", empty), F.col("quality_score"), "created_at")
    return a.unionByName(b).unionByName(c)


def fixes_edges(pulls: DataFrame, issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from a pull request to each issue it closes, where both are nodes."""
    refs = pulls.where(F.col("merged_at").isNotNull()).select(F.concat(F.lit("pr_review:"), F.col("id").cast("string")).alias("source_node_id"), "repo", F.explode("closing_issue_refs").alias("number"))
    ends = refs.join(issues.select("repo", "number", F.concat(F.lit("issue:"), F.col("id").cast("string")).alias("target_node_id")), ["repo", "number"])
    known = nodes.select("id")
    both = ends.join(known.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").join(known.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_semi")
    edge = F.concat_ws(":", F.lit("fixes"), "source_node_id", "target_node_id")
    return both.select(edge.alias("id"), "source_node_id", "target_node_id", F.lit("fixes").alias("edge_type"), F.lit(1.0).alias("confidence")).dropDuplicates(["id"])
