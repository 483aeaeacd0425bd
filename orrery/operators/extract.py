"""Symbols, calls and shader symbols from source text.

Files are scanned one by one in Python, since the scans carry state from line to line; names are then resolved by joins. The script
scanner reads tokens and braces, not types: it covers classes and their methods, functions, prototype methods, tagged aliases and
enums, exports and imports, and the call forms `new X()`, `this.m()`, `X.m()` and `value.m()`; the type of a value is found by `types`.

Defined cases: files without content have no symbols; source that does not close its braces, comments or strings is read to its end;
of symbols with equal ids the last in the file stays; names that several classes have resolve to none; a file must fit one task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, folders, text

SYMBOL_ROWS = "path string, ordinal int, name string, kind string, start_line int, end_line int, doc_comment string, parent_class string, exports array<string>, imports array<string>, code string"
CALL_ROWS = "path string, ordinal int, enclosing string, enclosing_class string, form string, object string, member string, place int"
SHADER_ROWS = "path string, ordinal int, name string, type string, file string, source string, doc_comment string, start_line int, end_line int"

#: Characters of source whose rows a worker holds at a time.
_SLICE = 1 << 18

_NAME = r"[A-Za-z_$][\w$]*"
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "constructor", "function", "return", "with"}


#: Comments and strings; what does not close goes to the end of the text, or of the line.
_HIDDEN = re.compile(r"""(//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(["'])((?:\\[\s\S]?|(?!\2)[^\\\n])*)(\2?)|`((?:\\[\s\S]?|[^`\\])*)(`?)""")
_VISIBLE = re.compile(r"[^\n]")
_BRACKETS = {pair: re.compile(f"[{re.escape(pair)}]") for pair in ("{}", "()", "[]")}


def masked(source: str) -> str:
    """The text with comments and the insides of strings blanked, line by line in place."""
    def blank(m: re.Match) -> str:
        comment, quote, inner, closing, template, end = m.groups()
        if comment is not None:
            return _VISIBLE.sub(" ", comment)
        return quote + _VISIBLE.sub(" ", inner) + closing if quote else "`" + _VISIBLE.sub(" ", template) + end

    return _HIDDEN.sub(blank, source)


def close_of(code: str, at: int, pair: str = "{}") -> int:
    """Place of the bracket that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in _BRACKETS[pair].finditer(code, at):
        if m.group() == pair[0]:
            depth += 1
        else:
            depth -= 1
            if not depth:
                return m.start()
    return len(code) - 1


def comment_before(source: str, at: int, opening: str = "/**") -> str | None:
    """The whole block comment that ends just before a place, if it begins with `opening`."""
    end = len(source[:at].rstrip())
    if not source.startswith("*/", end - 2):
        return None
    begin = source.rfind("/*", 0, end - 2)
    return source[begin:end] if begin >= 0 and source.startswith(opening, begin) else None


def doc_before(source: str, at: int) -> str | None:
    """The documentation comment that ends just before a place, without its marks."""
    whole = comment_before(source, at)
    return None if whole is None else whole[3:-2]


def described(doc: str | None) -> str | None:
    if doc is None:
        return None
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in doc.strip("\n").split("\n")]
    kept = []
    for line in lines:
        if line.startswith("@"):
            break
        kept.append(line)
    return "\n".join(kept).strip() or None


def tagged(doc: str | None, tag: str) -> str | None:
    found = re.search(rf"@{tag}\b[ \t]*([^\n*]*)", doc or "")
    return found.group(1).strip() if found else None


def script_symbols(source: str) -> list[dict]:
    """Symbols of one script, in the order: classes and methods, functions, variables, prototype methods."""
    code = masked(source)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect_right(starts, at)
    lines = source.split("\n")
    imports = re.findall(r"""^\s*import\b[^;]*?["']([^"']+)["']""", source, re.M)
    exported: list[str] = []
    default = re.search(rf"^export\s+default\s+(?:class\s+|function\s*\*?\s*)?({_NAME})?", code, re.M)
    if default:
        exported.append("default:default")
    for group in re.findall(r"^export\s*\{([^}]*)\}", code, re.M):
        exported += [p.split(" as ")[-1].strip() for p in group.split(",") if p.strip()]
    exported += re.findall(rf"^export\s+(?:default\s+)?(?:async\s+)?(?:class|function|const|let|var)\s+({_NAME})", code, re.M)
    frozen = re.search(rf"^export\s+default\s+(?:Object\.freeze|Frozen)\(({_NAME})\)", code, re.M)
    default_names = {frozen.group(1)} if frozen else {default.group(1)} if default and default.group(1) else set()
    at_depth = _depths(code)

    out: list[dict] = []
    classes: set[str] = set()

    def add(name: str, kind: str, start: int, end: int, doc: str | None, parent: str | None = None) -> None:
        a, b = line(start), line(end)
        out.append({"name": name, "kind": kind, "start_line": a, "end_line": b, "doc_comment": described(doc), "parent_class": parent, "code": "\n".join(lines[a - 1 : b])})

    for m in re.finditer(rf"^(?:export\s+(?:default\s+)?)?class\s+({_NAME})[^{{]*\{{", code, re.M):
        if at_depth[m.start()]:
            continue
        end = close_of(code, m.end() - 1)
        name = m.group(1)
        classes.add(name)
        add(name, "class", m.start(), end, doc_before(source, m.start()))
        for k in re.finditer(rf"^[ \t]*(?:static\s+|async\s+|\*\s*|get\s+|set\s+)*({_NAME})\s*\(", code[m.end() : end], re.M):
            at = m.end() + k.start() + len(k.group()) - len(k.group().lstrip())
            opening = m.end() + k.end() - 1
            body = code.find("{", close_of(code, opening, "()"))
            if at_depth[at] == at_depth[m.end() - 1] + 1 and k.group(1) not in _NOT_METHODS and not k.group(1).startswith("_") and 0 <= body < end and not re.match(r"\s*(?:get|set)\s", k.group()):
                add(k.group(1), "method", at, close_of(code, body), doc_before(source, at), name)
    for m in re.finditer(rf"^(export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*({_NAME})\s*\(", code, re.M):
        if at_depth[m.start()]:
            continue
        body = code.find("{", close_of(code, m.end() - 1, "()"))
        doc = doc_before(source, m.start())
        alias = tagged(doc, "alias")
        if alias:
            classes.add(alias)
            add(alias, "class", m.start(), close_of(code, body), doc)
        elif m.group(1) or m.group(2) in exported or m.group(2) in default_names:
            add(m.group(2), "function", m.start(), close_of(code, body), doc)
    for m in re.finditer(rf"^(export\s+)?(?:const|let|var)\s+({_NAME})\s*=", code, re.M):
        if at_depth[m.start()]:
            continue
        end = m.end()
        while end < len(code) and (code[end] != ";" or at_depth[end]):
            end += 1
        doc, name = doc_before(source, m.start()), m.group(2)
        if tagged(doc, "enum") is not None:
            add(name, "enum", m.start(), min(end, len(code) - 1), doc)
        elif (m.group(1) or name in default_names or name in exported) and name not in classes:
            add(name, "constant", m.start(), min(end, len(code) - 1), doc)
    for m in re.finditer(rf"^({_NAME})\.prototype\.({_NAME})\s*=", code, re.M):
        if at_depth[m.start()] or m.group(1) not in classes or m.group(2).startswith("_"):
            continue
        end = m.end()
        while end < len(code) and (code[end] != ";" or at_depth[end]):
            end += 1
        add(m.group(2), "method", m.start(), min(end, len(code) - 1), doc_before(source, m.start()), m.group(1))
    exports = list(dict.fromkeys(exported))
    return [s | {"exports": exports, "imports": imports, "ordinal": i} for i, s in enumerate(out)]


def script_calls(source: str) -> list[dict]:
    """Calls in one script with the function or method around them; a bare call has the form `bare`."""
    code = masked(source)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line_at = lambda at: bisect_right(starts, at)
    around = sorted((s["start_line"], -s["end_line"], s["name"], s["parent_class"]) for s in script_symbols(source) if s["kind"] in ("method", "function", "class", "constant"))
    for m in re.finditer(rf"^(?:async\s+)?function\s+({_NAME})\s*\(", code, re.M):
        body = code.find("{", close_of(code, m.end() - 1, "()"))
        around.append((line_at(m.start()), -line_at(close_of(code, body)), m.group(1), None))
    for m in re.finditer(r"^\s*constructor\s*\(", code, re.M):
        body = code.find("{", close_of(code, m.end() - 1, "()"))
        owner = next((n for a, b, n, p in around if p is None and a <= line_at(m.start()) <= -b), None)
        around.append((line_at(m.end()), -line_at(close_of(code, body)), owner, None))
    out = []
    form = re.compile(rf"\bnew\s+({_NAME})\s*\(|\b({_NAME}(?:\.{_NAME})*)\.({_NAME})\s*\(|(?<![\w$.])({_NAME})\s*\(")
    for m in form.finditer(code):
        line = line_at(m.start())
        inner = max((x for x in around if x[0] <= line <= -x[1]), key=lambda x: (x[0], x[1]), default=None)
        if m.group(1):
            kind, object_, member = "new", m.group(1), None
        elif m.group(3):
            kind, object_, member = "this" if m.group(2) == "this" else "member", m.group(2), m.group(3)
            if object_.startswith("new "):
                continue
        else:
            if m.group(4) in _NOT_METHODS | {"super"} or re.search(r"(?:function|new)\s*\*?\s*$", code[max(0, m.start() - 40) : m.start()]) or re.match(r"[^()]*\)\s*\{", code[m.end() :]):
                continue
            kind, object_, member = "bare", None, m.group(4)
        out.append({"enclosing": inner[2] if inner else None, "enclosing_class": inner[3] if inner else None, "form": kind, "object": object_, "member": member, "place": m.start()})
    return [c | {"ordinal": i} for i, c in enumerate(out)]


_DECLARED = re.compile(rf"^(?:export\s+(?:default\s+)?)?(?:(?:var|let|const)\s+({_NAME})\s*=\s*)?(?:(class|function)\b\s*\*?\s*({_NAME})?|(Object\.freeze)\b)", re.M)
_MEMBER = re.compile(rf"({_NAME})\s*\(")


def _depths(code: str) -> list[int]:
    """How many braces are open before each character, and at the end."""
    return [0, *accumulate((c == "{") - (c == "}") for c in code)]


def _block(code: str, at: int, stop: int | None = None) -> tuple[int, int] | None:
    """Places of the first brace from `at` on (before `stop`) and of the one that closes it."""
    begin = code.find("{", at, len(code) if stop is None else stop)
    return None if begin < 0 else (begin, close_of(code, begin))


def snapshot_symbols(source: str) -> list[dict]:
    """Symbols of one script by its braces: classes, functions and frozen enums outside any block, and what stands directly in a
    class's block as `name(...) {`, accessors and private members included, constructors not. Comments keep their marks."""
    code, lines = masked(source), source.split("\n")
    depth = _depths(code)
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect_right(starts, at)
    found: list[tuple[int, int, str, str, str | None]] = []
    for m in _DECLARED.finditer(code):
        variable, kind, own, frozen = m.groups()
        name = variable if frozen else own or variable
        if depth[m.start()] or name is None:
            continue
        block = _block(code, m.end())
        end = block[1] if block else m.start()
        found.append((m.start(), end, name, "enum" if frozen else kind, None))
        if kind != "class" or not block:
            continue
        for x in _MEMBER.finditer(code, block[0], block[1]):
            body = close_of(code, x.end() - 1, "()") + 1
            opens = re.compile(r"\s*\{").match(code, body)
            if depth[x.start()] == depth[block[0]] + 1 and opens and x.group(1) not in _NOT_METHODS:
                first = max(starts[line(x.start()) - 1], block[0] + 1)
                lead = code[first : x.start()]
                found.append((first + len(lead) - len(lead.lstrip()), close_of(code, opens.end() - 1), x.group(1), "method", name))
    out = []
    for k, (at, end, name, kind, parent) in enumerate(sorted(found)):
        a, b = line(at), line(end)
        out.append({"name": name, "kind": kind, "start_line": a, "end_line": b, "doc_comment": comment_before(source, at), "parent_class": parent, "code": "\n".join(lines[a - 1 : b]), "exports": [], "imports": [], "ordinal": k})
    return out


#: What a shader's declarations begin with, and the types of the functions and constants that are told (fixed values).
INTERFACE = {"uniform": "uniform", "in": "varying", "out": "varying", "varying": "varying"}
RETURNED = re.compile(r"void|float|vec[234]|mat[234]|int|bool|sampler\w+")
CONSTANT = re.compile(r"float|vec[234]|mat[234]|int|bool")


def shader_path(path: str) -> str:
    """The path from Source on, or the file's name."""
    found = re.search(r"Source/(.+)$", path)
    return f"Source/{found.group(1)}" if found else re.split(r"[\\/]", path)[-1]


def _shader_declarations(code: str) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, kind, name) of each declaration outside blocks. A declaration is a run of words up to `;`, `{` or `=`; brackets
    and, after a function's name, its parameters are passed over."""
    words: list[tuple[int, str]] = []
    call, at = False, 0
    token = re.compile(r"\w+|[;{}()\[\]=]")
    while m := token.search(code, at):
        at, sign = m.end(), m.group()
        if sign[0].isalnum() or sign[0] == "_":
            words.append((m.start(), sign))
            continue
        if sign in "([":
            call = call or (sign == "(" and len(words) == 2)
            at = close_of(code, m.start(), "()" if sign == "(" else "[]") + 1
            continue
        names = [w for _, w in words]
        first = names[0] if names else ""
        end = close_of(code, m.start()) if sign == "{" else m.start()
        if first in INTERFACE and sign == ";" and len(names) > 2:
            yield words[0][0], end, INTERFACE[first], names[-1]
        elif first == "struct" and sign == "{" and len(names) == 2:
            yield words[0][0], end, "struct", names[1]
        elif first == "const" and sign == "=" and len(names) == 3 and CONSTANT.fullmatch(names[1]):
            yield words[0][0], end, "const", names[2]
        elif call and sign in "{;" and RETURNED.fullmatch(first):
            yield words[0][0], end, "function", names[1]
        words, call = [], False
        if sign == "=":
            at = code.find(";", at) + 1 or len(code)
        elif sign == "{":
            at = end + 1


def shader_symbols(source: str, path: str) -> list[dict]:
    """Uniforms, varyings, functions, structs, defines and constants of one shader that stand outside blocks. The source of functions
    and structs is all their lines, that of the others the line they begin on."""
    code, lines = masked(source), source.split("\n")
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda at: bisect_right(starts, at)
    directive = re.compile(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", re.M)
    found = []
    for m in directive.finditer(code):
        if name := re.match(r"\s*#\s*define\s+(\w+)", m.group()):
            found.append((m.start() + len(m.group()) - len(m.group().lstrip()), m.start(), "define", name.group(1)))
    plain = directive.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)
    found += _shader_declarations(plain)
    out = []
    for k, (at, end, kind, name) in enumerate(sorted(found)):
        a = line(at)
        b = line(end) if kind in ("function", "struct") else a
        out.append({"name": name, "type": kind, "file": shader_path(path), "source": "\n".join(lines[a - 1 : b]), "doc_comment": comment_before(source, at, "/*"), "start_line": a, "end_line": b, "ordinal": k})
    return out


def _each(files: DataFrame, scan, schema: str) -> DataFrame:  # noqa: ANN001
    """Rows of all files' scans; a worker holds those of some `_SLICE` characters of source at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, held = [], 0
            for p, c in zip(f.path, f.content, strict=True):
                if isinstance(c, str):
                    rows += [{"path": p} | r for r in scan(c, p)]
                    held += len(c)
                if held > _SLICE:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """Rows of the symbols table (and their code) from files of path and content; of equal ids the last in file order stays."""
    rows = _each(files, lambda c, p: script_symbols(c), SYMBOL_ROWS).withColumn("id", text.symbol_id("path", "name", "kind"))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("ordinal")))
    return rows.withColumn("__n", last).where("__n = 1").select("id", "name", "kind", F.col("path").alias("file_path"), "start_line", "end_line", "doc_comment", "exports", "imports", "parent_class", "code")


def source_code(found: DataFrame) -> DataFrame:
    """Code of symbols that have any."""
    return found.where(F.trim("code") != "").select(F.col("id").alias("symbol_id"), "name", "file_path", "start_line", "end_line", "code")


def version_symbols(files: DataFrame) -> DataFrame:
    return _each(files, lambda c, p: snapshot_symbols(c), SYMBOL_ROWS).withColumnRenamed("path", "file_path")


def shaders(files: DataFrame) -> DataFrame:
    """Rows of the shader table; of equal names the last by path and line stays."""
    rows = _each(files.dropDuplicates(["path"]), shader_symbols, SHADER_ROWS)
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("file"), F.desc("start_line")))
    return rows.withColumn("__n", last).where("__n = 1").select(F.concat(F.lit("shader/"), "name").alias("id"), "name", "type", "file", "source", "doc_comment", "start_line", "end_line")


def symbol_map(found: DataFrame) -> DataFrame:
    """(key, symbol columns): methods by `Class.member`; other names by themselves, one class first, none if classes are many."""
    methods = found.where(F.coalesce("parent_class", F.lit("")) != "").withColumn("key", F.concat_ws(".", "parent_class", "name"))
    plain = found.where(F.coalesce("parent_class", F.lit("")) == "").withColumn("key", F.col("name"))
    w = Window.partitionBy("key")
    ranked = plain.withColumns({"__c": F.count_if(F.col("kind") == "class").over(w), "__n": F.row_number().over(w.orderBy(F.col("kind") != "class", "file_path", "start_line"))})
    one = ranked.where("__c < 2 and __n = 1").drop("__c", "__n")
    last = F.row_number().over(w.orderBy(F.desc("file_path"), F.desc("start_line")))
    return methods.withColumn("__n", last).where("__n = 1").drop("__n").unionByName(one)


def method_owners(found: DataFrame) -> DataFrame:
    """(name, owners): the classes that have a method of the name."""
    return found.where("kind = 'method' and parent_class is not null").groupBy("name").agg(F.sort_array(F.collect_set("parent_class")).alias("owners"))


def calls_of(files: DataFrame) -> DataFrame:
    """All calls of the files, scanned once and stored."""
    return folders.stored(_each(files, lambda c, p: script_calls(c), CALL_ROWS), "calls")


def call_edges(files: DataFrame, found: DataFrame, typed: bool = True, calls: DataFrame | None = None) -> DataFrame:
    """Edges of calls whose both ends are known: construct, call and static_call; each once.

    Symbols and calls (`calls_of`, if they are at hand) are as many as the files, so all joins are by sorting: none is sent to the driver and all executors.

    A call on a value goes to the class that it names; else to the method of the value's type, if `typed` (see `types`); else to the only class that
    has a method of that name.
    """
    from . import types

    calls = (calls_of(files) if calls is None else calls).where("form <> 'bare' and enclosing is not null")
    found = folders.stored(found.select("id", "name", "kind", "file_path", "start_line", "parent_class"), "symbols")
    known = folders.stored(symbol_map(found).select("key", "id", "name", "parent_class"), "names").hint("merge")
    source = known.select(F.col("key").alias("__from"), F.col("id").alias("source_id"), F.col("key").alias("source_name")).hint("merge")
    target = known.select(F.col("key").alias("__to"), F.col("id").alias("target_id")).hint("merge")
    owners = method_owners(found).where(F.size("owners") == 1).select(F.col("name").alias("member"), F.col("owners")[0].alias("__owner")).hint("merge")
    here = F.when(F.col("enclosing_class").isNotNull(), F.concat_ws(".", "enclosing_class", "enclosing")).otherwise(F.col("enclosing"))
    rows = calls.withColumn("__from", here).join(source, "__from")
    direct = F.when(F.col("form") == "new", F.col("object")).when(F.col("form") == "this", F.concat_ws(".", "enclosing_class", "member")).otherwise(F.concat_ws(".", "object", "member"))
    exact = rows.withColumn("__to", direct).join(target, "__to", "left")
    if typed:
        told, above = types.call_types(files)
        open_calls = exact.where("target_id is null and (form = 'member' or form = 'this' and enclosing_class is not null)").select("path", "place", "member").join(told.hint("merge"), ["path", "place"])
        exact = exact.join(types.targets(open_calls, above, known).hint("merge"), ["path", "place"], "left")
    else:
        exact = exact.withColumns({"typed_id": F.lit(None).cast("string"), "typed_name": F.lit(None).cast("string")})
    guess = F.when((F.col("form") == "member") & F.coalesce("target_id", "typed_id").isNull() & F.col("__owner").isNotNull(), F.concat_ws(".", "__owner", "member"))
    again = exact.join(owners, "member", "left").withColumn("__guess", guess).join(target.select(F.col("__to").alias("__guess"), F.col("target_id").alias("__id")).hint("merge"), "__guess", "left")
    upper = F.substring("object", 1, 1).rlike("[A-Z]")
    kind = F.when(F.col("form") == "new", "construct").when((F.col("form") == "member") & F.col("target_id").isNotNull() & upper, "static_call").otherwise("call")
    name = F.when(F.col("target_id").isNotNull(), F.col("__to")).when(F.col("typed_id").isNotNull(), F.col("typed_name")).otherwise(F.col("__guess"))
    edges = again.select("source_id", F.coalesce("target_id", "typed_id", "__id").alias("target_id"), "source_name", name.alias("target_name"), kind.alias("edge_type"), F.lit(1.0).alias("weight"))
    return edges.where("target_id is not null").dropDuplicates(["source_id", "target_id", "edge_type"])


def call_stats(files: DataFrame, found: DataFrame) -> DataFrame:
    """(outcome, n): calls by form, and edges by type."""
    calls = calls_of(files)
    forms = calls.groupBy(F.concat(F.lit("form:"), "form").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    edges = call_edges(files, found, calls=calls).groupBy(F.concat(F.lit("edge:"), "edge_type").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return forms.unionByName(edges)


# --- shaders and scripts --------------------------------------------------------------------------------------------


def render_stage(file: str = "file") -> Column:
    """The stage that a shader's path tells: by the first known part, else by the folder below Shaders."""
    folder = F.lower(F.regexp_extract(file, r"Shaders/(\w+)", 1))
    out = F.when(folder != "", folder)
    for part, stage in reversed(fixed.STAGE_PATHS):
        out = F.when(F.contains(F.col(file), F.lit(part)), F.lit(stage)).otherwise(out)
    return out


def link_shaders(found: DataFrame, scripts: DataFrame, prefixes: tuple[str, ...] = fixed.SHADER_PREFIXES) -> DataFrame:
    """``found`` with related_js_symbols (by the known names, else by the name, else by the file) and related_render_stage."""
    last = Window.partitionBy("name").orderBy(F.desc("file_path"), F.desc("start_line"))
    by_name = scripts.withColumn("__n", F.row_number().over(last)).where("__n = 1").select(F.col("name").alias("js"), F.col("id").alias("js_id"))
    spark = found.sparkSession
    known = spark.createDataFrame([(k, i, v) for k, vs in fixed.KNOWN_SHADER_SYMBOLS.items() for i, v in enumerate(vs)], "name string, i int, js string")
    first = known.join(by_name, "js").groupBy("name").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "js_id"))), lambda x: x["js_id"])).alias("k"))
    clean = F.regexp_replace("name", "^(" + "|".join(map(re.escape, prefixes)) + ")", "")
    head = F.get(F.filter(F.split(clean, "[_A-Z]"), lambda p: p != ""), F.lit(0))
    upper = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 10_000))
    out = found.drop("related_js_symbols", "related_render_stage").withColumns({"__a": upper(head), "__b": upper(clean)}).join(first, "name", "left")
    for c in ("a", "b"):
        out = out.join(by_name.select(F.col("js").alias(f"__{c}"), F.col("js_id").alias(f"{c}_id")), f"__{c}", "left")
    folder = lambda c: F.element_at(F.concat(F.array(F.lit(".")), F.split(c, "/")), -2)
    place = scripts.select("id", "file_path", "start_line", folder("file_path").alias("dir"), F.lower(F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.js$", "")).alias("base"))
    keyed = place.select("id", "file_path", "start_line", F.concat(F.lit("d:"), "dir").alias("key")).unionByName(place.select("id", "file_path", "start_line", F.concat(F.lit("b:"), "base").alias("key")))
    best = keyed.groupBy("key").agg(F.min(F.struct("file_path", "start_line", "id")).alias("m"))
    out = out.withColumns({"__d": F.concat(F.lit("d:"), folder("file")), "__e": F.concat(F.lit("b:"), F.lower(folder("file")))})
    for c in ("d", "e"):
        out = out.join(best.select(F.col("key").alias(f"__{c}"), F.col("m").alias(f"{c}_m")), f"__{c}", "left")
    by_file = F.least("d_m", "e_m")["id"]
    related = F.when(F.size(F.coalesce("k", F.array().cast("array<string>"))) > 0, F.col("k")).otherwise(F.filter(F.array(F.coalesce("a_id", "b_id", by_file)), lambda x: x.isNotNull()))
    return out.withColumns({"related_js_symbols": related, "related_render_stage": render_stage("file")}).select(*found.columns, *[c for c in ("related_js_symbols", "related_render_stage") if c not in found.columns])
