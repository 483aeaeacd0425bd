"""Context packs under a token budget.

A pack is a row; its sections are columns. Giving up the last element until the pack fits keeps the longest prefix whose cost leaves
room, so it is one expression over running sums; any number of packs is cut in one job. What an element costs is worked out once, as a
list of numbers beside the section, and the steps that cut a pack fold over those numbers.

Defined cases: null texts cost nothing; an empty list section costs what its empty text does; a pack that cannot fit is marked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text

Cost = Callable[[Column], Column]


def tokens(x: Column | str) -> Column:
    return text.token_estimate(x)


def _sum(costs: Column) -> Column:
    return F.aggregate(costs, F.lit(0).cast("long"), lambda s, c: s + c)


def _fitting(costs: Column, room: Column) -> Column:
    """How many running sums of the costs, which are not negative, stay within the room: one fold."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))

    def step(a: Column, c: Column) -> Column:
        total = a["s"] + c
        return F.struct(total.alias("s"), (a["n"] + (total <= room).cast("int")).alias("n"))

    return F.aggregate(costs, start, step, lambda a: a["n"])


def prefix_within(costs: Column, room: Column, least: int = 0) -> Column:
    """How many of the first elements fit the room together, `least` at least."""
    return F.greatest(_fitting(F.transform(costs, lambda c: c.cast("long")), room), F.least(F.size(costs), F.lit(least)))


def _json(e: Column) -> Column:
    """What an element adds to the length of a JSON list: itself and a comma."""
    return text.utf16_length(F.to_json(e)) + 1


def _json_tokens(costs: Column) -> Column:
    """Tokens of the JSON list of elements that add so much: the brackets, less the comma that the last has too many."""
    return F.ceil((1 + F.greatest(_sum(costs), F.lit(1))) / 4).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often `body` mentions it and wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


Step = Callable[[Column], Column]


class Budget:
    """A pack's sections with their costs, and steps that cut it.

    element: what an element of a list costs; whole: what other sections cost; as_json: lists that cost what their JSON does, of which
    those in free_if_empty cost nothing while empty. A pack is one struct that goes from step to step: sections, their costs, the budget
    and whether anything was cut. A step leaves a pack within its budget as it is.
    """

    def __init__(self, frame: DataFrame, budget: Column, element: dict[str, Cost], whole: dict[str, Cost] | None = None, as_json: Sequence[str] = (), free_if_empty: Sequence[str] = ()) -> None:
        self.frame, self.budget, self.element, self.whole, self.as_json, self.free_if_empty = frame, budget, element, whole or {}, as_json, free_if_empty
        self.sections = (*element, *as_json, *self.whole)
        self.fields = ("truncated", "budget", *self.sections, *map(self._at, self.sections))
        self.steps: list[Step] = []

    @staticmethod
    def _at(section: str) -> str:
        return f"__cost_{section}"

    def _costs(self, section: str, value: Column) -> Column:
        if section in self.whole:
            return self.whole[section](value).cast("long")
        cost = _json if section in self.as_json else self.element[section]
        return F.transform(value, lambda e: cost(e).cast("long"))

    def of(self, pack: Column, section: str) -> Column:
        costs = pack[self._at(section)]
        if section in self.whole:
            return costs
        if section not in self.as_json:
            return _sum(costs)
        return F.when(F.size(costs) == 0, F.lit(0).cast("long")).otherwise(_json_tokens(costs)) if section in self.free_if_empty else _json_tokens(costs)

    def total(self, pack: Column, but: Sequence[str] = ()) -> Column:
        return sum((self.of(pack, n) for n in self.sections if n not in but), F.lit(0).cast("long"))

    def _with(self, pack: Column, **new: Column) -> Column:
        return F.struct(*[new.get(f, pack[f]).alias(f) for f in self.fields])

    def _when_over(self, then: Callable[[Column, Column], Column]) -> None:
        """A step for packs over their budget; `then` gets the pack and its total."""
        self.steps.append(lambda pack: let(self.total(pack), lambda total: F.when(total > pack["budget"], then(pack, total)).otherwise(pack)))

    def _replace(self, section: str, new: Callable[[Column, Column], Column]) -> None:
        """new: the section's new value and its costs, as a struct of v and c, from the pack and the room that the rest leaves."""

        def then(pack: Column, total: Column) -> Column:
            room = pack["budget"] - (total - self.of(pack, section))
            return let(let(room, lambda r: new(pack, r)), lambda n: self._with(pack, **{section: n["v"], self._at(section): n["c"], "truncated": pack["truncated"] | ~n["v"].eqNullSafe(pack[section])}))

        self._when_over(then)

    def drop_last(self, section: str, least: int = 0) -> None:
        """Keep the first elements that the rest leaves room for, `least` at least."""

        def new(pack: Column, room: Column) -> Column:
            costs = pack[self._at(section)]
            keep = prefix_within(costs, 4 * room - 1 if section in self.as_json else room, least)
            return let(keep, lambda k: F.struct(F.slice(pack[section], F.lit(1), k).alias("v"), F.slice(costs, F.lit(1), k).alias("c")))

        self._replace(section, new)

    def clear(self, section: str) -> None:
        self._replace(section, lambda pack, _: F.struct(F.slice(pack[section], 1, 0).alias("v"), F.slice(pack[self._at(section)], 1, 0).alias("c")))

    def clear_together(self, sections: Sequence[str]) -> None:
        """Give up all of some sections at once."""

        def then(pack: Column, _: Column) -> Column:
            held = sum((F.size(pack[n]) for n in sections), F.lit(0))
            return self._with(pack, truncated=pack["truncated"] | (held > 0), **{f: F.slice(pack[f], 1, 0) for n in sections for f in (n, self._at(n))})

        self._when_over(then)

    def change(self, section: str, new: Callable[[Column, Column], Column]) -> None:
        """Another value for the section, from it and from the room that the rest leaves."""
        self._replace(section, lambda pack, room: let(new(pack[section], room), lambda v: F.struct(v.alias("v"), self._costs(section, v).alias("c"))))

    def cut_texts(self, section: str, most: int, name: str | None = None) -> None:
        def one(e: Column) -> Column:
            value = e[name] if name else e
            cut = F.when(tokens(value) > most, text.truncate_text(value, most)).otherwise(value)
            return e.withField(name, cut) if name else cut

        self.change(section, lambda c, _: F.transform(c, one))

    def finish(self, minimum: Sequence[str]) -> DataFrame:
        """The cut packs with truncated, total_tokens, token_budget, unavoidable_overflow and minimum_possible_tokens (what is left
        without `minimum`)."""
        cut = F.col("truncated") if "truncated" in self.frame.columns else F.lit(False)
        pack = F.struct(cut.alias("truncated"), self.budget.cast("long").alias("budget"), *[F.col(n) for n in self.sections], *[self._costs(n, F.col(n)).alias(self._at(n)) for n in self.sections])
        out = self.frame.withColumn("__pack", pack)
        for step in self.steps:
            out = out.withColumn("__pack", let(F.col("__pack"), step))
        done = let(F.col("__pack"), lambda p: F.struct(p.alias("p"), self.total(p).alias("t"), self.total(p, minimum).alias("m")))
        rest = [c for c in self.frame.columns if c not in (*self.sections, "truncated")]
        d = F.col("__done")
        over = d["t"] > d["p"]["budget"]
        return out.withColumn("__done", done).select(
            *rest, *[d["p"][n].alias(n) for n in (*self.sections, "truncated")], d["t"].alias("total_tokens"), d["p"]["budget"].alias("token_budget"), over.alias("unavoidable_overflow"), F.when(over, d["m"]).alias("minimum_possible_tokens")
        )


def _issue(e: Column) -> Column:
    return tokens(e["title"]) + tokens(e["body"]) + 30


def _source(e: Column) -> Column:
    return tokens(e["code"]) + 20


def _stage(e: Column) -> Column:
    return tokens(e["name"]) + tokens(e["description"]) + 10


def fold_caps(frame: DataFrame, section: str, cost: Cost, name: str, cap: int, overhead: int, keep_first: bool) -> DataFrame:
    """Elements in order while they fit a section's cap together. One that does not is cut if more than 100 tokens are left, else
    left out; later, smaller ones may still fit. The first source is always kept, cut to the cap if it must be.

    The fold is over the costs; it keeps places, of which there are no more than the cap has room for.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(-1).alias("cut"), F.lit(0).cast("long").alias("room"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        left = F.lit(cap).cast("long") - a["used"]
        first = (x["i"] == 0) if keep_first else F.lit(False)
        fits, cut = x["c"] <= left, (x["c"] > left) & ((left > 100) | first)
        put = F.when(fits | cut, F.concat(a["kept"], F.array(x["i"]))).otherwise(a["kept"])
        used = F.when(fits, a["used"] + x["c"]).when(cut, F.lit(cap).cast("long")).otherwise(a["used"])
        return F.struct(used.alias("used"), put.alias("kept"), F.when(cut, x["i"]).otherwise(a["cut"]).alias("cut"), F.when(cut, left - overhead).otherwise(a["room"]).alias("room"), (a["over"] | ~fits).alias("over"))

    costs = F.transform(section, lambda e, i: F.struct(cost(e).cast("long").alias("c"), i.alias("i")))

    def kept(fold: Column) -> Column:
        def one(i: Column) -> Column:
            e = F.get(section, i)
            return F.when(i == fold["cut"], e.withField(name, text.truncate_text(e[name], fold["room"]))).otherwise(e)

        return F.struct(F.transform(fold["kept"], one).alias("v"), fold["over"].alias("over"))

    held = frame.withColumn("__kept", let(F.aggregate(costs, start, step), kept))
    return held.withColumns({section: F.col("__kept")["v"], "truncated": F.col("truncated") | F.col("__kept")["over"]}).drop("__kept")


def context_pack(packs: DataFrame, budget: int | Column) -> DataFrame:
    """Cut packs of symbol (struct), source, callgraph and issues (lists of structs) first to the sections' caps, then to the budget."""
    cap = fixed.SECTION_TOKENS
    limit = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    json = lambda c: tokens(F.to_json(c))
    doc = F.col("symbol")["doc_comment"]
    long_doc = (json(F.col("symbol")) > cap["symbol"]) & (tokens(doc) > cap["symbol"] - 50)
    out = packs.withColumn("truncated", F.coalesce(long_doc, F.lit(False)))
    out = out.withColumn("symbol", F.when(F.col("truncated"), F.col("symbol").withField("doc_comment", text.truncate_text(doc, cap["symbol"] - 50))).otherwise(F.col("symbol")))
    out = fold_caps(out, "source", _source, "code", cap["source"], 20, True)
    out = fold_caps(out, "issues", _issue, "body", cap["issues"], 30, False)
    lengths = F.transform("callgraph", lambda e: _json(e).cast("long"))
    keep = let(lengths, lambda c: F.when(_json_tokens(c) > cap["callgraph"], _fitting(c, F.lit(4 * cap["callgraph"] - 1))).otherwise(F.size(c)))
    out = out.withColumn("__keep", keep).withColumns({"truncated": F.col("truncated") | (F.col("__keep") < F.size("callgraph")), "callgraph": F.slice("callgraph", F.lit(1), F.col("__keep"))}).drop("__keep")

    b = Budget(out, limit, {"source": _source, "issues": _issue}, {"symbol": json}, ["callgraph"])
    b.drop_last("source", 1)
    b.change("source", lambda c, room: F.transform(c, lambda e: e.withField("code", text.truncate_text(e["code"], F.greatest(room, F.lit(0)).cast("int")))))
    b.drop_last("issues")
    b.drop_last("callgraph")

    def shorter(c: Column, room: Column) -> Column:
        left = room - (tokens(F.to_json(c)) - tokens(c["doc_comment"]))
        return F.when(c["doc_comment"].isNull(), c).otherwise(c.withField("doc_comment", text.truncate_text(c["doc_comment"], F.greatest(left, F.lit(0)).cast("int"))))

    b.change("symbol", shorter)
    none = F.array().cast("array<string>")
    b.change("symbol", lambda c, _: c.withField("exports", none).withField("imports", none).withField("parent_class", F.lit(None).cast("string")).withField("doc_comment", F.lit(None).cast("string")))
    done = b.finish(())
    name = F.when(F.coalesce(F.col("symbol")["parent_class"], F.lit("")) != "", F.concat_ws(".", F.col("symbol")["parent_class"], F.col("symbol")["name"])).otherwise(F.col("symbol")["name"])
    return done.withColumn("symbol_resolved", name)


def diagnostic_pack(packs: DataFrame, budget: int | Column = 6000) -> DataFrame:
    """Cut diagnosis packs: sources, issue bodies, issues, experiences, edges, stage texts, stages, long fixes and steps, fixes, steps."""
    limit = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    pattern = lambda e: tokens(F.concat(F.lit('"'), e["id"], F.lit('"'))) + 10 + tokens(e["name"]) + tokens(F.to_json(e["possibleCauses"])) + 10
    element: dict[str, Cost] = {
        "matched_patterns": pattern, "related_symbols": lambda e: tokens(e["name"]) + tokens(e["kind"]) + 10, "related_source": _source, "related_issues": _issue,
        "related_experiences": lambda e: tokens(e["title"]) + tokens(e["type"]) + 20, "render_stages": _stage, "investigation_steps": tokens, "fix_suggestions": tokens,
    }
    b = Budget(packs, limit, element, {}, ["callgraph"])
    b.drop_last("related_source")

    def bodies(c: Column, _: Column) -> Column:
        def one(e: Column) -> Column:
            most = F.greatest(F.lit(0), F.floor(limit / F.size(c)) - (tokens(e["title"]) + 30))
            return F.when((tokens(e["body"]) > most) & (most > 0), e.withField("body", text.truncate_text(e["body"], most.cast("int")))).otherwise(e)

        return F.transform(c, one)

    b.change("related_issues", bodies)
    for section in ("related_issues", "related_experiences", "callgraph"):
        b.drop_last(section)
    b.cut_texts("render_stages", 50, "description")
    b.drop_last("render_stages")
    b.cut_texts("fix_suggestions", 40)
    b.cut_texts("investigation_steps", 40)
    b.clear("fix_suggestions")
    b.clear("investigation_steps")
    return b.finish(("related_source", "related_issues", "callgraph", "render_stages", "investigation_steps", "fix_suggestions", "related_experiences"))


def skill_pack(packs: DataFrame, budget: int | Column) -> DataFrame:
    """Cut skill packs: experience and forum go whole, then edges, issues and sources from the end, then texts, stages, fixes, diagnosis.

    The diagnosis is matched_patterns, investigation_steps and diagnosis_fixes; its fixes and fix_suggestions both count.
    """
    limit = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    element: dict[str, Cost] = {
        "source": _source, "issues": _issue, "render_stages": _stage, "forum": _issue, "experience": lambda e: tokens(e["title"]) + tokens(e["summary"]) + 20,
        "investigation_steps": tokens, "diagnosis_fixes": tokens, "fix_suggestions": tokens,
    }
    whole: dict[str, Cost] = {"query": lambda c: tokens(c) + 20, "dispatch": lambda c: tokens(F.to_json(c)) + 10, "symbol": lambda c: tokens(F.to_json(c))}
    b = Budget(packs, limit, element, whole, ["callgraph", "matched_patterns"], ["matched_patterns"])
    b.clear("experience")
    b.clear("forum")
    b.drop_last("callgraph")
    b.drop_last("issues")
    b.drop_last("source", 1)
    b.cut_texts("source", 100, "code")
    b.cut_texts("render_stages", 50, "description")
    b.drop_last("render_stages")
    b.clear("fix_suggestions")
    b.clear_together(("matched_patterns", "investigation_steps", "diagnosis_fixes"))
    return b.finish(("source", "callgraph", "issues", "render_stages", "matched_patterns", "investigation_steps", "diagnosis_fixes", "forum", "experience", "fix_suggestions"))


def within_budget(rows: DataFrame, group: str, order: Sequence[str | Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each group, in order, while their running cost stays within the budget; adds `cost` and `running`."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("cost", cost).withColumn("running", F.sum("cost").over(window)).where(F.col("running") <= budget)
