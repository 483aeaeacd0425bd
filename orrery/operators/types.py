"""Types of values in scripts, spread along assignments, imports and returns across files, and calls resolved by them.

Each file is scanned once for facts about its values. A value is a name in a scope (a function, a method, or the file itself), a field of a class, or
what a function or method returns. Facts say that a value is an object of a class, is the same as another value, or is what a member of another
value's class holds or returns. Types then spread by joins over all files' facts, round by round, until nothing new is found; as there are finitely many
values and classes, this ends. A value with one class has that type; one that may have several has none.

Covered: `new C()`, `this`, names, fields, calls of functions and methods, chains of members, returned values, fields of classes, prototype methods,
inherited members, named, renamed and default imports and exports of relative paths. Not covered: parameters, conditional expressions, containers.
Calls on what another call returns have types, but are no edges: an edge needs a named value.

Defined cases: files without content have no facts; names that are not declared are the file's own; cyclic assignments and imports add nothing;
a class that extends itself, by whatever way, has no further members by that.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folders
from . import extract

FACT_ROWS = "path string, target string, kind string, source string, member string"
#: Steps up the chain of classes that members are looked for.
MOST_ANCESTORS = 10

_N = extract._NAME
_FUNCTION = re.compile(rf"\b(?:async\s+)?function\s*\*?\s*({_N})?\s*\(")
_ARROW = re.compile(rf"\b(?:const|let|var)\s+({_N})\s*=\s*(?:async\s+)?(?:\([^()]*\)|{_N})\s*=>\s*\{{")
_CLASS = re.compile(rf"\bclass\s+({_N})(?:\s+extends\s+({_N}))?\s*\{{")
_METHOD = re.compile(rf"(?:static\s+|async\s+|\*\s*|get\s+|set\s+)*(#?{_N})\s*\(")
_PROTOTYPE = re.compile(rf"({_N})\.prototype\.({_N})\s*=\s*(?:async\s+)?function\b[^(]*\(")
_SETS = re.compile(rf"(?:\b(?:const|let|var)\s+|(?<![\w$.]))({_N})\s*=(?![=>])\s*|\bthis\.({_N})\s*=(?![=>])\s*|\breturn\s+")
_IMPORT = re.compile(rf"""^\s*import\s+(?:({_N})\s*,?\s*)?(?:\{{([^}}]*)\}}\s*)?from\s*["'](\.[^"']*)["']""", re.M)
_PATH = re.compile(rf"(?:this|{_N})(?:\.{_N})*")
_ENDS = re.compile(r"[ \t]*(?:[;,)\]}\n]|$)")


@dataclass
class _Scope:
    begin: int
    end: int
    key: str
    owner: str | None = None
    is_class: bool = False
    names: set[str] = field(default_factory=set)


class _File:
    """One script's scopes and facts."""

    def __init__(self, source: str, path: str) -> None:
        self.source, self.code, self.path = source, extract.masked(source), path
        self.facts: list[dict] = []
        self.renamed: set[str] = set()
        self.scopes = [_Scope(0, len(self.code) + 1, "")]
        self._find_scopes()

    def add(self, target: str, kind: str, source: str | None, member: str | None = None) -> None:
        if source is not None:
            self.facts.append({"target": target, "kind": kind, "source": source, "member": member})

    def _body(self, opening: int) -> tuple[int, int] | None:
        """The block after the brackets that open at a place."""
        at = extract.close_of(self.code, opening, "()") + 1
        m = re.compile(r"\s*\{").match(self.code, at)
        return (m.end() - 1, extract.close_of(self.code, m.end() - 1)) if m else None

    def _add_scope(self, opening: int, key: str, owner: str | None = None) -> None:
        if body := self._body(opening):
            inner = self.code[opening + 1 : extract.close_of(self.code, opening, "()")]
            self.scopes.append(_Scope(opening, body[1], key, owner, names=set(re.findall(_N, inner))))

    def _find_scopes(self) -> None:
        code, made = self.code, {m.group(1) for m in _PROTOTYPE.finditer(self.code)}
        methods: set[int] = set()
        depth = extract._depths(code)
        for m in _CLASS.finditer(code):
            end = extract.close_of(code, m.end() - 1)
            self.scopes.append(_Scope(m.end() - 1, end, m.group(1), m.group(1), True))
            self.add(self.node("", m.group(1)), "class", m.group(1))
            if m.group(2):
                self.add(m.group(1), "extends", m.group(2))
            for x in _METHOD.finditer(code, m.end(), end):
                if depth[x.start()] == depth[m.end() - 1] + 1 and x.group(1) not in extract._NOT_METHODS - {"constructor"} and self._body(x.end() - 1):
                    self._add_scope(x.end() - 1, f"{m.group(1)}.{x.group(1)}", m.group(1))
                    methods.add(x.end() - 1)
        for m in _PROTOTYPE.finditer(code):
            self._add_scope(m.end() - 1, f"{m.group(1)}.{m.group(2)}", m.group(1))
            methods.add(m.end() - 1)
        for m in _FUNCTION.finditer(code):
            if m.end() - 1 not in methods:
                name = m.group(1)
                if name in made:
                    self.add(self.node("", name), "class", name)
                self._add_scope(m.end() - 1, name or f"#{m.start()}", name if name in made else None)
        for m in _ARROW.finditer(code):
            self.scopes.append(_Scope(m.end() - 1, extract.close_of(code, m.end() - 1), m.group(1)))
        self.scopes.sort(key=lambda s: (s.begin, -s.end))
        for m in re.finditer(rf"\b(?:const|let|var)\s+({_N})", code):
            self.around(m.start())[-1].names.add(m.group(1))

    def around(self, at: int) -> list[_Scope]:
        """The scopes that hold a place, the innermost last."""
        return [s for s in self.scopes if s.begin <= at <= s.end]

    def node(self, scope: str, name: str) -> str:
        return f"{self.path}|{scope}|{name}"

    def value(self, at: int, name: str) -> str:
        """The value that a name means at a place."""
        return next((self.node(s.key, name) for s in reversed(self.around(at)) if name in s.names), self.node("", name))

    def owner(self, at: int) -> str | None:
        """The class that `this` is an object of."""
        return next((s.owner for s in reversed(self.around(at)) if s.owner), None)

    def path_value(self, at: int, dotted: str) -> str | None:
        """The value of `name.field.field` or `this.field`; values between are facts of their own."""
        first, *rest = dotted.split(".")
        if first == "this":
            owner = self.owner(at)
            if owner is None:
                return None
            now = f"this:{owner}"
            self.add(now, "is", owner)
        else:
            now = self.value(at, first)
        for name in rest:
            here = f"{now}.{name}"
            self.add(here, "field", now, name)
            now = here
        return now

    def expression(self, at: int, target: str) -> None:
        """What the expression at a place says about the target."""
        code = self.code
        if m := re.compile(rf"(?:await\s+)?new\s+({_N})\s*\(").match(code, at):
            end = extract.close_of(code, m.end() - 1, "()") + 1
            made = f"{self.path}|new|{m.start()}"
            if m.group(1) in self.renamed:
                self.add(made, "new", self.node("", m.group(1)))
            else:
                self.add(made, "is", m.group(1))
            self._chained(end, made, target)
        elif m := re.compile(rf"(?:await\s+)?({_PATH.pattern})\s*(\()?").match(code, at):
            end = m.end()
            if not m.group(2):
                if _ENDS.match(code, end) or code[end - 1 : end] == "\n":
                    self.add(target, "same", self.path_value(at, m.group(1)))
                return
            object_, _, member = m.group(1).rpartition(".")
            result = f"{self.path}|call|{m.start()}"
            if object_:
                self.add(result, "result", self.path_value(at, object_), member)
            else:
                self.add(result, "same", f"{self.value(at, member)}()")
            self._chained(extract.close_of(code, end - 1, "()") + 1, result, target)

    def _chained(self, at: int, value: str, target: str) -> None:
        """Members that follow a call: `.m()` and `.p`, up to the expression's end."""
        step = re.compile(rf"\s*\.({_N})\s*(\()?")
        while m := step.match(self.code, at):
            here = f"{value}.{m.group(1)}" + ("()" if m.group(2) else "")
            self.add(here, "result" if m.group(2) else "field", value, m.group(1))
            value, at = here, extract.close_of(self.code, m.end() - 1, "()") + 1 if m.group(2) else m.end()
        if _ENDS.match(self.code, at):
            self.add(target, "same", value)

    def _modules(self) -> None:
        """Imports and exports as values that are the same."""
        def other(spec: str) -> str:
            to = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), spec))
            return to if re.search(r"\.\w+$", posixpath.basename(to)) else f"{to}.js"

        def same(here: str, there: str) -> None:
            self.add(here, "same", there)
            self.add(f"{here}()", "same", f"{there}()")

        for m in _IMPORT.finditer(self.source):
            pairs = [("default", m.group(1))] if m.group(1) else []
            for part in (m.group(2) or "").split(","):
                names = part.split()
                if names:
                    pairs.append((names[0], names[-1]))
            for theirs, mine in pairs:
                self.renamed.add(mine)
                same(self.node("", mine), f"{other(m.group(3))}||{theirs}")
        for m in re.finditer(rf"^export\s+default\s+(?:class\s+|(?:async\s+)?function\s*\*?\s*)?({_N})", self.code, re.M):
            same(self.node("", "default"), self.node("", m.group(1)))
        for m in re.finditer(r"^export\s*\{([^}]*)\}", self.code, re.M):
            for part in m.group(1).split(","):
                names = part.split()
                if len(names) == 3:
                    same(self.node("", names[2]), self.node("", names[0]))

    def scan(self) -> list[dict]:
        self._modules()
        for m in _SETS.finditer(self.code):
            scopes = self.around(m.start())
            inner = scopes[-1]
            if m.group(1):
                target = f"field:{inner.owner}.{m.group(1)}" if inner.is_class else self.value(m.start(), m.group(1))
            elif m.group(2):
                owner = self.owner(m.start())
                if owner is None:
                    continue
                target = f"field:{owner}.{m.group(2)}"
            else:
                target = f"result:{inner.key}" if inner.owner and "." in inner.key else f"{self.node('', inner.key)}()"
            self.expression(m.end(), target)
        for m in re.finditer(rf"({_PATH.pattern})\.({_N})\s*\(", self.code):
            value = self.path_value(m.start(), m.group(1))
            self.add(f"{m.start()}", "calls", value)
        return self.facts


def _kept(frame: DataFrame) -> DataFrame:
    return folders.stored(frame, "types")


def script_facts(source: str, path: str) -> list[dict]:
    """Facts of one script: target, kind, source, member.

    `is`: an object of a class; `class`: the class itself; `new`: an object of the class that a value is; `same`: another value; `field` and `result`: what
    a member of another value's class holds or returns; `extends`: a class and the one it extends; `calls`: the place of a call and the value it is called on.
    """
    return _File(source, path).scan()


def facts(files: DataFrame) -> DataFrame:
    return extract._each(files, script_facts, FACT_ROWS)


def ancestors(found: DataFrame) -> DataFrame:
    """(class, ancestor, steps): each class itself at 0 steps, and those it extends."""
    up = found.where("kind = 'extends'").select(F.col("target").alias("c"), F.col("source").alias("a")).distinct().hint("merge")
    out = step = _kept(up.select(F.col("c").alias("class"), F.col("a").alias("ancestor"), F.lit(1).alias("steps")))
    for n in range(2, MOST_ANCESTORS + 1):
        step = _kept(step.join(up, step["ancestor"] == up["c"]).select("class", F.col("a").alias("ancestor"), F.lit(n).alias("steps")).where("class <> ancestor").join(out.hint("merge"), ["class", "ancestor"], "left_anti").distinct())
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def spread(found: DataFrame) -> DataFrame:
    """(value, type, is_class): all that values may be, by rounds of joins until nothing new is found.

    Facts and values are as many as the files, so joins are by sorting; each round stores what it found, and only the last rounds' folders make a plan.
    """
    kind = lambda k: found.where(F.col("kind") == k)
    above = ancestors(found).hint("merge")
    members = _kept(kind("field").unionByName(kind("result")).select("target", "kind", "source", "member").distinct()).hint("merge")
    known = new = _kept(kind("is").select(F.col("target").alias("value"), F.col("source").alias("type"), F.lit(False).alias("is_class")).union(kind("class").select("target", "source", F.lit(True))).distinct())
    same = _kept(kind("same").select("target", "source").distinct())
    made = _kept(kind("new").select("target", "source").distinct()).hint("merge")
    while not new.isEmpty():
        on = new.where("not is_class").join(members, new["value"] == members["source"])
        direct = on.select("target", "kind", "type", "member")
        inherited = direct.join(above, direct["type"] == above["class"]).select("target", "kind", F.col("ancestor").alias("type"), "member")
        way = direct.unionByName(inherited).select("target", F.concat("kind", F.lit(":"), "type", F.lit("."), "member").alias("source")).distinct()
        way = _kept(way.join(same.hint("merge"), ["target", "source"], "left_anti"))
        more = known.join(way.hint("merge"), known["value"] == way["source"]).select(F.col("target").alias("value"), "type", "is_class")
        along = new.join(same.hint("merge"), new["value"] == same["source"]).select(F.col("target").alias("value"), "type", "is_class")
        objects = new.where("is_class").join(made, new["value"] == made["source"]).select(F.col("target").alias("value"), "type", F.lit(False).alias("is_class"))
        new = _kept(more.unionByName(along).unionByName(objects).distinct().join(known.hint("merge"), ["value", "type", "is_class"], "left_anti"))
        same, known = same.unionByName(way), known.unionByName(new)
    return known


def call_types(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, place, type) of the calls whose value has one type, and the classes' ancestors."""
    found = _kept(facts(files))
    held = spread(found).where("not is_class").groupBy("value").agg(F.collect_set("type").alias("types")).where(F.size("types") == 1)
    calls = found.where("kind = 'calls'").select("path", F.col("target").cast("int").alias("place"), F.col("source").alias("value"))
    return calls.join(held.hint("merge"), "value").select("path", "place", F.col("types")[0].alias("type")).distinct(), ancestors(found)


def targets(calls: DataFrame, above: DataFrame, known: DataFrame) -> DataFrame:
    """(path, place, typed_id, typed_name): the method of a call's type, or that of its nearest ancestor that has one.

    calls: path, place, type, member; known: key and id, as `extract.symbol_map` has them.
    """
    own = calls.select("path", "place", "member", F.col("type").alias("owner"), F.lit(0).alias("steps"))
    up = calls.join(above.hint("merge"), calls["type"] == above["class"]).select("path", "place", "member", F.col("ancestor").alias("owner"), "steps")
    hits = own.unionByName(up).withColumn("key", F.concat_ws(".", "owner", "member")).join(known.select("key", "id").hint("merge"), "key")
    nearest = F.row_number().over(Window.partitionBy("path", "place").orderBy("steps", "key"))
    return hits.withColumn("__n", nearest).where("__n = 1").select("path", "place", F.col("id").alias("typed_id"), F.col("key").alias("typed_name"))
