"""Source trees to units: a scan of files, and a scanner of top-level Go declarations.

The scanner reads tokens, not a grammar: it finds declarations of functions, methods,
types, constants and variables at depth zero, their parameters, results, fields and
methods, and calls and literals in bodies. Generic type arguments are kept as written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import exprs

PRUNED = (".git", "vendor", "node_modules", "testdata")
PAIR = "array<struct<name:string,type:string>>"
RELATION = "array<struct<target:string,kind:string,start_line:int,end_line:int,in_body:boolean>>"
UNIT = f"filepath string, package string, language string, unit_type string, name string, start_line int, end_line int, content string, description string, signature string, receiver string, parameters {PAIR}, returns {PAIR}, fields array<struct<name:string,type:string,tag:string>>, methods array<string>, value_type string, value string, relations {RELATION}"

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\.\.\.|\d[\w.]*|\n|[^\s\w]""", re.S)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def is_source(path: Column) -> Column:
    """Go files that are no tests, outside pruned folders; used by the full scan and by updates alike."""
    pruned = "|".join(re.escape(p) for p in PRUNED)
    return path.rlike(r"\.go$") & ~path.rlike(r"_test\.go$") & ~path.rlike(rf"(^|/)({pruned})/")


def scan(spark: SparkSession, root: str, root_name: str | None = None) -> DataFrame:
    """filepath (relative to root), content of a project's sources. An unreadable file fails the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.go").load(root)
    base = (root_name or root).rstrip("/") + "/"
    path = F.substring_index(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, -1)
    return files.select(path.alias("filepath"), F.decode("content", "UTF-8").alias("content")).filter(is_source(F.col("filepath")))


class _Scanner:
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        self.code = [t for t in self.tokens if t[0] != "\n" and not t[0].startswith(("//", "/*"))]
        self.comments = [t for t in self.tokens if t[0].startswith(("//", "/*"))]
        self.starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]

    def line(self, at: int) -> int:
        from bisect import bisect_right

        return bisect_right(self.starts, at)

    def close(self, i: int) -> int:
        """Index of the token that closes the bracket at i."""
        stack = []
        for j in range(i, len(self.code)):
            t = self.code[j][0]
            if t in _CLOSE:
                stack.append(_CLOSE[t])
            elif stack and t == stack[-1]:
                stack.pop()
                if not stack:
                    return j
        return len(self.code) - 1

    def source(self, i: int, j: int) -> str:
        """Text of the tokens i to j - 1."""
        return self.text[self.code[i][1] : self.code[j - 1][2]] if j > i else ""

    def doc(self, at: int) -> str:
        """Comments that end on the line before, joined upwards without a gap."""
        found, below = [], self.line(at)
        for text, start, end in reversed(self.comments):
            if end > at:
                continue
            alone = not self.text[self.starts[self.line(start) - 1] : start].strip()
            if below - self.line(end) > 1 or not alone:
                break
            found.append(text)
            below = self.line(start)
        lines = "\n".join(reversed(found)).split("\n") if found else []
        return "\n".join(re.sub(r"\*/$", "", re.sub(r"^(//|/\*)", "", x.strip())).strip() for x in lines)

    def split(self, i: int, j: int, by: str = ",") -> list[tuple[int, int]]:
        """Ranges of tokens between separators at depth zero."""
        out, start, k = [], i, i
        while k < j:
            t = self.code[k][0]
            if t in _CLOSE:
                k = self.close(k)
            elif t == by:
                out.append((start, k))
                start = k + 1
            k += 1
        return [r for r in [*out, (start, j)] if r[1] > r[0]]

    def end_of_line(self, i: int, j: int) -> int:
        """First token after i that starts a new line at depth zero."""
        k = i
        while k < j:
            if self.code[k][0] in _CLOSE:
                k = self.close(k)
            k += 1
            if k < j and self.line(self.code[k][1]) > self.line(self.code[k - 1][2] - 1) and self.code[k - 1][0] not in ("=", ",", "+", "|", "&", "."):
                return k
            if k < j and self.code[k][0] == ";":
                return k
        return j

    def params(self, i: int, j: int) -> list[dict]:
        """Parameters between brackets: names share the type that follows them."""
        parts = [(a, b) for a, b in self.split(i, j)]
        named = any(b - a > 1 and re.match(r"[^\W\d]\w*$", self.code[a][0]) and self.code[a][0] not in _KEYWORDS and self.code[a + 1][0] not in (".", "[") or b - a > 1 and self.code[a + 1][0] == "[" and b - a > 2 and self.code[a + 2][0] == "]" for a, b in parts)
        if not named:
            return [{"name": "", "type": self.source(a, b)} for a, b in parts]
        out, waiting = [], []
        for a, b in parts:
            waiting.append(self.code[a][0])
            if b - a > 1:
                out += [{"name": n, "type": self.source(a + 1, b)} for n in waiting]
                waiting = []
        return out

    def body(self, i: int, j: int) -> list[dict]:
        """Calls and composite literals in order, each target once, without noise."""
        found: dict[str, dict] = {}
        for k in range(i, j):
            t, start, end = self.code[k]
            if t not in ("(", "{") or k == i:
                continue
            a = k
            while a > i and (re.match(r"[^\W\d]\w*$", self.code[a - 1][0]) and self.code[a - 1][0] not in _KEYWORDS and (a == k or self.code[a][0] == ".") or self.code[a - 1][0] == "." and a < k):
                a -= 1
            target = self.source(a, k)
            if not target or target.startswith(".") or t == "{" and not re.search(r"(^|\.)[A-Z]\w*$", target):
                continue
            if t == "{" and a > i and self.code[a - 1][0] in ("if", "for", "switch", "range", "select"):
                continue
            if t == "{" and a > i + 1 and self.code[a - 1][0] == "]":
                continue
            noise = target in exprs.BUILTINS or target.split(".")[0] in exprs.STDLIB and "." in target
            if target not in found and not noise:
                found[target] = {"target": target, "kind": "calls" if t == "(" else "instantiates", "start_line": self.line(self.code[a][1]), "end_line": self.line(self.code[self.close(k)][2] - 1), "in_body": True}
        return list(found.values())

    def units(self) -> Iterator[dict]:
        code, k, package = self.code, 0, ""
        while k < len(code):
            word = code[k][0]
            if word == "package" and k + 1 < len(code):
                package = code[k + 1][0]
                k += 2
            elif word == "import":
                k = self.close(k + 1) + 1 if k + 1 < len(code) and code[k + 1][0] == "(" else self.end_of_line(k, len(code))
            elif word == "func":
                unit, k = self.function(k)
                yield unit | {"package": package}
            elif word in ("type", "const", "var") and k + 1 < len(code):
                grouped = code[k + 1][0] == "("
                end = self.close(k + 1) if grouped else self.end_of_line(k, len(code))
                specs, at = [], k + 2 if grouped else k + 1
                while at < end:
                    stop = self.end_of_line(at, end)
                    specs.append((at, stop))
                    at = stop + 1 if stop < end and code[stop][0] == ";" else stop
                whole = k, end + 1 if grouped else end
                for a, b in specs:
                    yield (self.type_spec(whole, a, b) if word == "type" else self.value_spec(whole, word, a, b)) | {"package": package}
                k = end + 1 if grouped else max(end, k + 1)
            else:
                k = self.close(k) + 1 if word in _CLOSE else k + 1

    def unit(self, kind: str, name: str, i: int, j: int, doc: str, **more) -> dict:
        empty = {"signature": "", "receiver": "", "parameters": [], "returns": [], "fields": [], "methods": [], "value_type": "", "value": "", "relations": []}
        return empty | {"filepath": self.path, "language": "go", "unit_type": kind, "name": name, "start_line": self.line(self.code[i][1]), "end_line": self.line(self.code[j - 1][2] - 1), "content": self.source(i, j), "description": doc} | more

    def function(self, k: int) -> tuple[dict, int]:
        code, i, receiver, relations = self.code, k + 1, "", []
        span = lambda j: {"start_line": self.line(code[k][1]), "end_line": self.line(code[j - 1][2] - 1), "in_body": False}
        if i < len(code) and code[i][0] == "(":
            j = self.close(i)
            receiver = self.source(i, j + 1)
            i = j + 1
        name = code[i][0] if i < len(code) else ""
        i += 1
        if i < len(code) and code[i][0] == "[":
            i = self.close(i) + 1
        if i >= len(code) or code[i][0] != "(":
            return self.unit("function", name, k, min(i, len(code)), self.doc(code[k][1])), i
        j = self.close(i)
        params = self.params(i + 1, j)
        stop = result = j + 1
        line = self.line(code[j][2] - 1)
        while stop < len(code) and self.line(code[stop][1]) == line and not (code[stop][0] == "{" and code[stop - 1][0] not in ("interface", "struct")):
            if code[stop][0] in _CLOSE:
                stop = self.close(stop)
            stop += 1
            line = self.line(code[stop - 1][2] - 1)
        listed = stop > result and code[result][0] == "(" and self.close(result) == stop - 1
        returns = self.params(result + 1, stop - 1) if listed else [{"name": "", "type": self.source(result, stop)}] if stop > result else []
        has_body = stop < len(code) and code[stop][0] == "{" and self.line(code[stop][1]) == line
        end = self.close(stop) + 1 if has_body else stop
        if receiver:
            words = receiver.strip("()").split()
            base = (words[1] if len(words) > 1 else receiver.strip("()")).removeprefix("*")
            relations += [{"target": base, "kind": "belongs_to"} | span(end)] if base else []
        relations += [{"target": p["type"], "kind": "uses_type"} | span(end) for p in [*params, *returns] if _user_type(p["type"])]
        relations += self.body(stop, end) if has_body else []
        signature = self.text[code[k][1] : code[stop][1]].strip() if has_body else self.source(k, end)
        return self.unit("method" if receiver else "function", name, k, end, self.doc(code[k][1]), receiver=receiver, parameters=params, returns=returns, signature=signature, relations=relations), end

    def type_spec(self, whole: tuple[int, int], a: int, b: int) -> dict:
        code, kind, fields, methods, relations = self.code, "type", [], [], []
        i, j = whole
        span = {"start_line": self.line(code[i][1]), "end_line": self.line(code[j - 1][2] - 1), "in_body": False}
        at = a + 1
        if at < b and code[at][0] == "[" and at + 1 < b and code[at + 1][0] != "]":
            at = self.close(at) + 1
        at += at < b and code[at][0] == "="
        if at + 1 < b and code[at][0] in ("struct", "interface") and code[at + 1][0] == "{":
            kind, end, m = code[at][0], self.close(at + 1), at + 2
            while m < end:
                stop = self.end_of_line(m, end)
                if kind == "struct":
                    fields += self.fields(m, stop)
                else:
                    methods.append(self.source(m, stop))
                m = stop + 1 if stop < end and code[stop][0] == ";" else stop
        for f in fields:
            if _user_type(f["type"]):
                relations.append({"target": f["type"], "kind": "embeds" if f["name"] == f["type"] or f["type"].endswith("." + f["name"]) else "uses_type"} | span)
        relations += [{"target": m, "kind": "embeds"} | span for m in methods if "(" not in m and _user_type(m)]
        return self.unit(kind, code[a][0], i, j, self.doc(code[i][1]), fields=fields, methods=methods, relations=relations)

    def fields(self, i: int, j: int) -> list[dict]:
        code, tag = self.code, ""
        if code[j - 1][0][0] in "`\"":
            tag, j = code[j - 1][0], j - 1
        names, k = [code[i][0]], i + 1
        while k + 1 < j and code[k][0] == ",":
            names.append(code[k + 1][0])
            k += 2
        if k >= j or code[i][0] == "*" or code[k][0] == "." and k == i + 1:
            own = self.source(i, j)
            return [{"name": own.split(".")[-1] if not own.startswith("*") else own[1:].split(".")[-1], "type": own, "tag": tag}]
        return [{"name": n, "type": self.source(k, j), "tag": tag} for n in names]

    def value_spec(self, whole: tuple[int, int], word: str, a: int, b: int) -> dict:
        code, equals = self.code, next((k for k in range(a, b) if self.code[k][0] == "="), b)
        typed = a + 1
        while typed + 1 < equals and code[typed][0] == ",":
            typed += 2
        value, name = self.source(equals + 1, b) if equals + 1 < b else "", code[a][0]
        if value and any(s in name.lower() for s in exprs.SECRETS):
            value = '"[REDACTED]"'
        doc = self.doc(code[whole[0]][1]) or (self.doc(code[a][1]) if word == "const" else "")
        return self.unit("constant" if word == "const" else "variable", name, a, b, doc, value_type=self.source(typed, equals), value=value)


def _user_type(t: str) -> bool:
    return bool(t) and t.removeprefix("*").removeprefix("[]") not in exprs.PRIMITIVES


def go_units(path: str, text: str) -> list[dict]:
    """Units of one Go file. Of a broken file, those that could be told, and one of type ``error``, which ``extract`` sets apart."""
    found: list[dict] = []
    scanner = _Scanner(path, text or "")
    signs = [t[0] for t in scanner.code]
    fault = "" if sum(signs.count(x) for x in "([{") == sum(signs.count(x) for x in ")]}") else "brackets do not match"
    try:
        for unit in scanner.units():
            if unit["name"]:
                found.append(unit)
            else:
                fault = "a declaration breaks off"
    except IndexError:
        fault = "a declaration breaks off"
    if fault:
        line = scanner.line(len(scanner.text))
        empty = {"signature": "", "receiver": "", "parameters": [], "returns": [], "fields": [], "methods": [], "value_type": "", "value": "", "relations": []}
        after = found[-1]["end_line"] if found else 0
        found.append(empty | {"filepath": path, "package": "", "language": "go", "unit_type": "error", "name": "", "start_line": after + 1, "end_line": line, "content": "", "description": fault})
    return found


#: Extractors by language: (path, text) -> units.
EXTRACTORS: dict[str, Callable[[str, str], list[dict]]] = {"go": go_units}


def extract(files: DataFrame, language: str = "go") -> DataFrame:
    """Units of files (filepath, content); those of broken files up to where they break off, which ``errors`` tells."""
    return _scanned(files, language).filter("unit_type <> 'error'")


def errors(files: DataFrame, language: str = "go") -> DataFrame:
    """(filepath, after_line, last_line, error) of files that could not be scanned to their end."""
    found = _scanned(files, language).filter("unit_type = 'error'")
    return found.select("filepath", (F.col("start_line") - 1).alias("after_line"), F.col("end_line").alias("last_line"), F.col("description").alias("error"))


def _scanned(files: DataFrame, language: str) -> DataFrame:
    if language not in EXTRACTORS:
        raise ValueError(f"unsupported language: {language}")
    make = EXTRACTORS[language]
    from pyspark.sql import types as T

    names = T._parse_datatype_string(UNIT).names

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [u for path, text in zip(part["filepath"], part["content"], strict=True) for u in make(path, text)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("filepath", "content").mapInPandas(run, UNIT)


def unit_id() -> Column:
    """The stable id of the symbol of a row of units."""
    return exprs.stable_id(*(F.col(c) for c in ("language", "package", "unit_type", "name", "receiver", "signature", "content")))


def symbols(units: DataFrame) -> DataFrame:
    """Symbols of units, with stable id, hash and role."""
    return units.select(unit_id().alias("id"), "filepath", "package", "language", "start_line", "end_line", "content", F.sha2("content", 256).alias("content_hash"), "unit_type", exprs.role(F.col("unit_type"), F.col("name")).alias("role"), "name", "description", "signature", "receiver")


def relations(units: DataFrame) -> DataFrame:
    """from_id, ord, target, kind, resolver, confidence, evidence. A body's relation is scored without its file, as its evidence has none when it is found."""
    r = units.select(unit_id().alias("from_id"), "filepath", F.posexplode("relations").alias("ord", "r"))
    file = F.when(F.col("r.in_body"), "").otherwise(F.col("filepath"))
    confidence = exprs.relation_confidence(F.col("r.kind"), F.lit("heuristic"), file, F.col("r.start_line"), F.col("r.end_line"))
    evidence = F.struct("filepath", F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"))
    return r.select("from_id", "ord", F.col("r.target").alias("target"), F.col("r.kind").alias("kind"), F.lit("heuristic").alias("resolver"), confidence.alias("confidence"), evidence.alias("evidence"))
