"""Graphs from texts: programs in Python, SysML models, circuit descriptions, skills and rules.

Files are rows ``(path, text)``; every file is projected on its own by regular
expressions over columns (Python sources by their syntax tree, in the tasks), and what
names something in another file is settled by joins over all of them.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import Graph, GraphError, Limits
from ..storage import materialise

EMPTY = "map<string,string>"


def files(spark: SparkSession, path: str, pattern: str, max_files: int | None = 64) -> DataFrame:
    """``(path, text)`` of the files below ``path`` whose names match; ``ingest_budget`` beyond ``max_files``."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if max_files is not None and found.select("path").limit(max_files + 1).count() > max_files:
        raise GraphError("ingest_budget", f"more than {max_files} files")
    return found


#: Files that are read in one task.
FILES_A_TASK = 8192


def dealt(texts: DataFrame) -> DataFrame:
    """Files dealt evenly to tasks, however few files of a table they come from."""
    return texts.select("path", "text").repartition(1 + texts.count() // FILES_A_TASK, "path")


def _nodes(df: DataFrame, tag: str | Column, **props: Column) -> DataFrame:
    pairs = [x for k, v in props.items() for x in (F.lit(k), v)]
    shown = F.map_filter(F.create_map(F.lit("id"), F.col("hid"), *pairs, F.lit("recycle"), F.lit("persistent")), lambda k, v: F.coalesce(v, F.lit("")) != "")
    return df.select("hid", (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"), shown.alias("props")).groupBy("hid").agg(F.min("tag").alias("tag"), F.min_by("props", F.to_json("props")).alias("props"))


def _edges(df: DataFrame, relation: str | Column) -> DataFrame:
    relation = F.lit(relation) if isinstance(relation, str) else relation
    rows = df.where("src is not null and dist is not null and src <> dist").select(relation.alias("relation"), "src", "dist").distinct()
    return rows.select(F.concat(F.lit("E_"), "relation", F.lit("_"), "src", F.lit("_"), "dist").alias("hid"), "relation", "src", "dist", F.create_map().cast(EMPTY).alias("props"))


def _graph(nodes: list[DataFrame], edges: list[DataFrame], limits: Limits | None) -> Graph:
    n, e = nodes[0], edges[0]
    for more in nodes[1:]:
        n = n.union(more)
    for more in edges[1:]:
        e = e.union(more)
    return Graph(n, e, limits or Limits())


def _syntax(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per file: definitions ``(sym, name, kind, line, signature, owner)``, imports and calls of local names."""
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for batch in batches:
        out = []
        for path, text in zip(batch["path"], batch["text"], strict=True):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError):
                continue
            owners = [("", tree), *((c.name, c) for c in tree.body if isinstance(c, ast.ClassDef))]
            for owner, body in owners:
                for d in body.body:
                    name = f"{owner}.{d.name}" if owner and isinstance(d, functions) else getattr(d, "name", "")
                    if isinstance(d, functions):
                        out.append((path, "def", name, "method" if owner else "function", str(d.lineno), f"def {d.name}({', '.join(a.arg for a in d.args.args)})", owner))
                        out += [(path, "call", name, "", "", c.func.id, "") for c in ast.walk(d) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)]
                    elif isinstance(d, ast.ClassDef) and not owner:
                        out.append((path, "def", d.name, "class", str(d.lineno), f"class {d.name}", ""))
                    elif isinstance(d, ast.Import):
                        out += [(path, "import", a.name, "", "", "", "") for a in d.names]
                    elif isinstance(d, ast.ImportFrom) and d.module:
                        out.append((path, "import", d.module, "", "", "", ""))
        yield pd.DataFrame(out, columns=["path", "what", "name", "kind", "line", "signature", "owner"])


def code(texts: DataFrame, limits: Limits | None = None) -> Graph:
    """Modules, and the classes, functions and methods of Python ones: defines, owns, includes, calls."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    texts = dealt(texts)
    modules = texts.select(T.slug("MOD", F.col("path")).alias("hid"), "path", stem.alias("stem"))
    found = texts.where(F.endswith("path", F.lit(".py"))).select("path", "text").mapInPandas(_syntax, "path string, what string, name string, kind string, line string, signature string, owner string")
    found = materialise(found, "syntax")  # every text is parsed once
    symbol = lambda name: T.slug("SYM", F.concat("path", F.lit(":"), name))
    defs = found.where("what = 'def'").withColumn("hid", symbol(F.col("name")))
    local = defs.select("path", F.col("name").alias("signature"), F.col("hid").alias("dist")).distinct()
    named = modules.groupBy("stem").agg(F.min("hid").alias("dist"))
    nodes = [_nodes(modules, "MOD", path=F.col("path"), name=F.col("stem")), _nodes(defs, "SYM", name=F.col("name"), kind=F.col("kind"), path=F.col("path"), line=F.col("line"), signature=F.col("signature"))]
    edges = [
        _edges(defs.select(T.slug("MOD", F.col("path")).alias("src"), F.col("hid").alias("dist")), "defines"),
        _edges(defs.where("owner <> ''").select(symbol(F.col("owner")).alias("src"), F.col("hid").alias("dist")), "owns"),
        _edges(found.where("what = 'import'").withColumn("stem", F.element_at(F.split("name", r"\."), -1)).join(named, "stem").select(T.slug("MOD", F.col("path")).alias("src"), "dist"), "includes"),
        _edges(found.where("what = 'call'").withColumn("src", symbol(F.col("name"))).join(local, ["path", "signature"]).select("src", "dist"), "calls"),
    ]
    return _graph(nodes, edges, limits)


#: Words that begin a definition in a model, and the tag of what they define.
_SYSML = {"package": "PKG", "part def": "PRT", "part": "PRT", "requirement def": "REQ", "requirement": "REQ", "port def": "POR", "port": "POR", "connection def": "CON", "connection": "CON", "interface def": "CON", "interface": "CON"}
_SYSML_EVENT = r"(?:\b(package|part(?:\s+def)?|requirement(?:\s+def)?|port(?:\s+def)?|connection(?:\s+def)?|interface(?:\s+def)?)\s+(?:<[^>]*>\s*)?'?([A-Za-z_]\w*)'?\s*(?::>?\s*([\w:]+))?)|(?:\bsatisfy\s+([\w:]+))|(?:\brequirementId\s*=\s*\"([^\"]+)\")|([{};])"


def sysml(texts: DataFrame, limits: Limits | None = None) -> Graph:
    """Packages, parts, requirements, ports and connections of models: contains, typedBy, satisfies.

    A file is a list of events -- definitions, braces, ends of statements -- and one fold over the
    list keeps the names of what encloses each definition.
    """
    import re

    event = re.compile(_SYSML_EVENT)
    comment = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                open_, waiting = [], None
                for m in event.finditer(comment.sub(" ", text or "")):
                    word, name, kind, target, number, mark = m.groups()
                    inside = "::".join(n for n in open_ if n)
                    if word:
                        waiting = name
                        out.append((path, "def", " ".join(word.split()), f"{inside}::{name}" if inside else name, inside, kind or ""))
                    elif target and inside:
                        out.append((path, "satisfy", "", inside, "", target))
                    elif number and inside:
                        out.append((path, "number", "", inside, "", number))
                    elif mark == "{":
                        open_.append(waiting or "")
                        waiting = None
                    elif mark == "}":
                        del open_[-1:]
                    elif mark == ";":
                        waiting = None
            yield pd.DataFrame(out, columns=["path", "what", "word", "qname", "inside", "target"])

    found = texts.select("path", "text").mapInPandas(run, "path string, what string, word string, qname string, inside string, target string")
    tags = F.create_map(*(F.lit(x) for kv in _SYSML.items() for x in kv))
    leaf = lambda c: F.element_at(F.split(c, "::"), -1)
    defs = found.where("what = 'def'").withColumn("tag", F.element_at(tags, F.col("word"))).withColumn("hid", F.concat("tag", F.lit("_"), F.regexp_replace("qname", r"[^A-Za-z0-9]+", "_"))).withColumn("leaf", leaf(F.col("qname")))
    numbers = found.where("what = 'number'").groupBy("path", "qname").agg(F.min("target").alias("number"))
    known = defs.groupBy("qname").agg(F.min("hid").alias("exact"))
    by_file = defs.groupBy("path", "leaf").agg(F.min("hid").alias("own"))
    by_leaf = defs.groupBy("leaf").agg(F.min("hid").alias("near"))

    def settled(rows: DataFrame) -> DataFrame:
        """What a name stands for: the thing of that full name, else one whose last part it is, of the same file before others."""
        rows = rows.withColumn("leaf", leaf(F.col("target")))
        near = rows.join(known.withColumnRenamed("qname", "target"), "target", "left").join(by_file, ["path", "leaf"], "left").join(by_leaf, "leaf", "left")
        return near.withColumn("dist", F.coalesce("exact", "own", "near"))

    outer = known.withColumnsRenamed({"qname": "inside", "exact": "src"})
    nodes = _nodes(defs.join(numbers, ["path", "qname"], "left"), F.col("tag"), name=F.col("leaf"), qname=F.col("qname"), path=F.col("path"), sysml_kind=F.replace("word", F.lit(" "), F.lit("_")), requirementId=F.col("number"))
    edges = [
        _edges(defs.where("inside <> ''").join(outer, "inside").select("src", F.col("hid").alias("dist")), "contains"),
        _edges(settled(defs.where("target <> ''").drop("leaf")).select(F.col("hid").alias("src"), "dist"), "typedBy"),
        _edges(settled(found.where("what = 'satisfy'").join(known.withColumnRenamed("exact", "src"), "qname")).select("src", "dist"), "satisfies"),
    ]
    return _graph([nodes], edges, limits)


def _all(text: str, pattern: str, *groups: str) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)]


def _matches(df: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """A row per match of a pattern, with its groups."""
    lists = df.select("path", *_all("text", pattern, *groups))
    return lists.select("path", F.explode(F.arrays_zip(*groups)).alias("m")).select("path", *(F.col(f"m.{g}").alias(g) for g in groups))


def circuit(texts: DataFrame, limits: Limits | None = None) -> Graph:
    """Components, nets and pins of circuit descriptions: owns, on_net, uses."""
    clean = dealt(texts).select("path", F.regexp_replace("text", r"(?m)#.*$", " ").alias("text"))
    pin_of = r"(?m)^[ \t]*(?:component|module)[ \t]+([A-Za-z_]\w*)[ \t]*:([^\n]*(?:\n[ \t]+[^\n]*|\n[ \t]*(?=\n))*)"
    types = _matches(clean, pin_of, "typ", "body").select("path", "typ", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^[ \t]*pin[ \t]+[\"']?([^\s\"']+)"), F.lit(1))).alias("pin"))
    parts = _matches(clean, r"(?m)^[ \t]*([A-Za-z_]\w*)[ \t]*=[ \t]*new[ \t]+([A-Za-z_]\w*)", "ref", "typ")
    signals = _matches(clean, r"(?m)^[ \t]*signal[ \t]+([A-Za-z_]\w*)", "net")
    ties = _matches(clean, r"(?m)^[ \t]*([\w.]+(?:\[[^\]]*\])?)[ \t]*~[ \t]*([\w.]+(?:\[[^\]]*\])?)", "a", "b").select("path", *(F.regexp_replace(c, r"\[[^\]]*\]$", "").alias(c) for c in ("a", "b")))
    named = lambda tag, name: T.slug(tag, F.concat("path", F.lit(":"), name))
    ends = ties.select("path", F.explode(F.array("a", "b")).alias("end"))
    dotted = F.contains("end", F.lit("."))
    used = ends.where(dotted).select("path", F.substring_index("end", ".", 1).alias("ref"), F.regexp_replace("end", r"^[^.]*\.", "").alias("pin"))
    pins = parts.join(types, ["path", "typ"]).select("path", "ref", "pin").union(used).distinct().withColumn("key", F.concat_ws(".", "ref", "pin"))
    refs = parts.select("path", "ref", "typ").union(used.select("path", "ref", F.lit(None).cast("string"))).groupBy("path", "ref").agg(F.max("typ").alias("typ"))
    both = ties.where(F.contains("a", F.lit(".")) & F.contains("b", F.lit("."))).withColumn("net", F.concat(F.lit("n_"), F.replace("a", F.lit("."), F.lit("_")), F.lit("_"), F.replace("b", F.lit("."), F.lit("_"))))
    nets = signals.union(ends.where(~dotted).select("path", F.col("end").alias("net"))).union(both.select("path", "net")).distinct()
    with_id = lambda df, tag, name: df.withColumn("hid", named(tag, F.col(name)))
    nodes = [
        _nodes(with_id(refs, "CMP", "ref"), "CMP", name=F.col("ref"), refdes=F.col("ref"), path=F.col("path"), ato_type=F.col("typ")),
        _nodes(with_id(nets, "NET", "net"), "NET", name=F.col("net"), net=F.col("net"), path=F.col("path")),
        _nodes(with_id(pins, "PIN", "key"), "PIN", name=F.col("key"), refdes=F.col("ref"), pin=F.col("pin"), path=F.col("path")),
    ]
    mixed = ties.where(F.contains("a", F.lit(".")) != F.contains("b", F.lit("."))).withColumn("first", F.contains("a", F.lit(".")))
    on_net = mixed.select("path", F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("pin"), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("net")).union(both.select("path", F.explode(F.array("a", "b")), "net"))
    plain = ties.where(~F.contains("a", F.lit(".")) & ~F.contains("b", F.lit(".")))
    edges = [
        _edges(pins.select(named("CMP", F.col("ref")).alias("src"), named("PIN", F.col("key")).alias("dist")), "owns"),
        _edges(on_net.select(named("PIN", F.col("pin")).alias("src"), named("NET", F.col("net")).alias("dist")), "on_net"),
        _edges(plain.select(named("NET", F.col("a")).alias("src"), named("NET", F.col("b")).alias("dist")), "uses"),
    ]
    return _graph(nodes, edges, limits)


#: Lists in a front matter, and the relation that each stands for.
_SKILL_LISTS = {"related": "paired_with", "paired_with": "paired_with", "triggers": "triggers", "governs": "governs", "depends": "uses"}


def skills(texts: DataFrame, limits: Limits | None = None) -> Graph:
    """Skills and rules by their front matter: paired_with, triggers, governs, uses."""
    front = texts.select("path", F.regexp_extract("text", r"(?s)\A---[ \t]*\n(.*?)\n---", 1).alias("front"))
    entry = lambda key: F.trim(F.trim(F.regexp_extract("front", rf"(?m)^{key}:[ \t]*(.+)$", 1)), F.lit("\"'"))
    rule = F.endswith("path", F.lit(".mdc"))
    folder, stem = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    name = F.coalesce(F.nullif(entry("name"), F.lit("")), F.when(~rule, F.nullif(folder, F.lit(""))), stem)
    rows = front.select("path", "front", name.alias("skill"), F.when(rule, "RUL").otherwise("SKL").alias("tag"), T.phrase(entry("description")).alias("phrase"))
    rows = rows.withColumn("hid", F.concat("tag", F.lit("_"), F.trim(F.regexp_replace("skill", r"[^A-Za-z0-9]+", "_"), F.lit("_"))))
    block = r"(?m)^({0}):[ \t]*(?:\[([^\]]*)\]|\n((?:[ \t]*-[ \t]+.+\n?)+))".format("|".join(_SKILL_LISTS))
    lists = rows.select("hid", *(F.regexp_extract_all(F.concat("front", F.lit("\n")), F.lit(block), F.lit(i + 1)).alias(g) for i, g in enumerate(("key", "inline", "items"))))
    each = lists.select("hid", F.explode(F.arrays_zip("key", "inline", "items")).alias("m")).select("hid", F.col("m.key").alias("key"), F.concat(F.split("m.inline", ","), F.split(F.regexp_replace("m.items", r"(?m)^[ \t]*-[ \t]+", ""), "\n")).alias("names"))
    named = each.select("hid", "key", F.explode(F.transform("names", lambda n: F.trim(F.trim(n), F.lit("\"'")))).alias("target")).where("target <> ''")
    relation = F.create_map(*(F.lit(x) for kv in _SKILL_LISTS.items() for x in kv))
    exact = rows.groupBy(F.col("skill").alias("target")).agg(F.min("hid").alias("exact"))
    loose = rows.groupBy(F.lower("skill").alias("low")).agg(F.min("hid").alias("near"))
    met = named.join(exact, "target", "left").withColumn("low", F.lower("target")).join(loose, "low", "left")
    edges = _edges(met.select(F.col("hid").alias("src"), F.coalesce("exact", "near").alias("dist"), F.element_at(relation, F.col("key")).alias("r")), F.col("r"))
    return _graph([_nodes(rows, F.col("tag"), name=F.col("skill"), skill_id=F.col("skill"), path=F.col("path"), phrase=F.col("phrase"))], [edges], limits)
