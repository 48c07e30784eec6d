"""Graphs of Python sources: definitions and references from the syntax tree, resolved by joins; facts about unsafe calls."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normal_path
from ..functions.text import module_qualname, path_signal, top_package
from ..storage import first_known, merged, saved
from .graph import contexts_for
from .rules import policy_breaches, risk_tier

# Results must agree with them. Larger files are left out unless a caller asks for all.
LARGEST_FILE = 1_000_000

ROWS = (
    "row string, kind string, path string, name string, qualname string, target string, line int, "
    "end_line int, signature string, docstring string, is_async boolean, source string, seq int, own string, step int, bound string"
)
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ROWS.split(", ")])
DOCSTRING_CHARS = 500
#: Rows that a batch has at least, but for the last one of a task.
BATCH_ROWS = 4096
DEFINITIONS = ("class", "function", "method", "test")


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    return f"{_dotted(node.value)}.{node.attr}".lstrip(".") if isinstance(node, ast.Attribute) else ""


def _is_test(path: str) -> bool:
    folders, _, name = path.rpartition("/")
    return name.startswith("test_") or name.endswith("_test.py") or "tests" in folders.split("/")


def _doc(node: ast.AST) -> str:
    return (ast.get_docstring(node) or "")[:DOCSTRING_CHARS]


def _parameters(a: ast.arguments) -> list[str]:
    """The parameters as they are declared, with what they are said to be but without defaults."""
    shown = lambda x: x.arg + (f": {ast.unparse(x.annotation)}" if x.annotation else "")
    starred = lambda x, stars: [stars + x.arg] if x else []
    return [*map(shown, a.posonlyargs + a.args), *starred(a.vararg, "*"), *map(shown, a.kwonlyargs), *starred(a.kwarg, "**")]


#: Fields of nodes that hold no nodes, or only such as say nothing here: names, operators and contexts.
_PLAIN = ("ctx", "op", "ops", "id", "attr", "arg", "name", "lineno", "module", "level", "asname", "simple", "is_async", "conversion", "kind", "type_comment", "kwd_attrs", "rest", "str")
#: Kinds of nodes to the fields that are looked into: one look-up for each node, of which there are very many.
_FIELDS = {
    kind: () if issubclass(kind, ast.Constant | ast.Global | ast.Nonlocal | ast.MatchSingleton) else tuple(f for f in kind._fields if f not in _PLAIN or kind is ast.arguments)
    for kind in vars(ast).values() if isinstance(kind, type) and issubclass(kind, ast.AST)
}
_WITH_GAPS = ("keys", "kw_defaults")


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below one, in the order of its fields, without operators and contexts."""
    out: list[ast.AST] = []
    for field in _FIELDS[node.__class__]:
        value = getattr(node, field, None)
        if value.__class__ is list:
            out += [x for x in value if x is not None] if field in _WITH_GAPS else value
        elif value is not None:
            out.append(value)
    return out


_SCOPES = (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)


def _below(node: ast.AST) -> list[ast.AST]:
    """A node and all below it, level by level."""
    out = [node]
    for x in out:
        out += _children(x)
    return out


def _walk(path: str, tree: ast.Module, out: list[dict]) -> None:
    """Rows of a file in the order of its text: the file, its definitions (``node``), what they hold, call, inherit and import
    (``edge``), and the names that imports bind (``binding``). A stack, so the depth of a tree doesn't matter."""
    test_file, whole = _is_test(path), f"file:{path}"
    add = lambda **x: out.append({"path": path, "seq": len(out), **x})
    add(row="file", kind="file", name=path.rpartition("/")[2], docstring=_doc(tree))
    todo: list[tuple[ast.AST, tuple[str, ...], tuple[str, str] | None]] = [(tree, (), None)]
    while todo:
        node, scope, caller = todo.pop()
        made = node.__class__
        if made in _SCOPES:
            line = node.lineno
            qualname, is_class = ".".join((*scope, node.name)), made is ast.ClassDef
            kind = "class" if is_class else "test" if test_file and node.name.startswith("test_") else "method" if scope else "function"
            own, bases = f"{kind}:{path}:{qualname}", [x for x in map(_dotted, node.bases) if x] if is_class else []
            signature = f"class {node.name}({', '.join(bases)})" if is_class else f"{node.name}({', '.join(_parameters(node.args))})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
            add(row="node", kind=kind, name=node.name, qualname=qualname, source=own, line=line, end_line=node.end_lineno, signature=signature, docstring=_doc(node), is_async=None if is_class else isinstance(node, ast.AsyncFunctionDef))
            # a class belongs to its file, a callable to what it stands in
            add(row="edge", kind="contains", source=whole if is_class or not scope else f"class:{path}:{'.'.join(scope)}", target=own)
            for base in bases:
                add(row="edge", kind="inherits", qualname=qualname, source=own, target=base, line=line)
            scope, caller = (*scope, node.name), caller if is_class else (own, qualname)
        elif made is ast.Import or made is ast.ImportFrom:
            line = node.lineno
            dots = "." * getattr(node, "level", 0)
            for x in node.names:
                plain = made is ast.Import
                module = x.name if plain else dots + (node.module or "")
                target = x.name if plain else dots + ".".join(filter(None, (node.module, x.name)))
                add(row="edge", kind="imports", qualname="", source=whole, name=module, target=target, line=line)
                add(row="binding", name=x.asname or (x.name.partition(".")[0] if plain else x.name), target=target)
        elif made is ast.Call and caller and (called := _dotted(node.func)):
            add(row="edge", kind="calls", qualname=caller[1], source=caller[0], target=called, line=node.lineno)
        todo += [(child, scope, caller) for child in reversed(_children(node))]


# Names of calls that facts are about.
SQL_CALLS, SHELL_CALLS, PLACEHOLDERS = ("execute", "executemany", "executescript"), ("run", "call", "check_call", "check_output", "Popen"), ("?", "%s")
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _built(node: ast.AST) -> str:
    """How a text is put together when the code runs, if it is."""
    if isinstance(node, ast.JoinedStr):
        return "f-string"
    if isinstance(node, ast.BinOp):
        return {ast.Add: "concatenation", ast.Mod: "percent"}.get(type(node.op), "")
    return "format" if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format" else ""


def _name(node: ast.AST) -> str:
    return node.id if isinstance(node, ast.Name) else ""


def _looked_into(test: ast.AST) -> str:
    """The container that a condition looks into, by one ``in`` or by ``.get``, whose result may be compared."""
    if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], ast.In | ast.NotIn):
        return _name(test.comparators[0])
    test = test.left if isinstance(test, ast.Compare) else test
    return _name(test.func.value) if isinstance(test, ast.Call) and isinstance(test.func, ast.Attribute) and test.func.attr == "get" else ""


def _locks(node: ast.With) -> bool:
    named = [x.context_expr.func if isinstance(x.context_expr, ast.Call) else x.context_expr for x in node.items]
    return any("lock" in (x.attr if isinstance(x, ast.Attribute) else _name(x)).lower() for x in named)


def _race(function: ast.AST) -> tuple[str, int] | None:
    """Whether a function looks into a container and sets something in it, and whether a lock stands around either; where."""
    looked, held, todo = {}, set(), [(x, False) for x in function.body]
    changed = set()
    while todo:
        node, locked = todo.pop()
        if isinstance(node, ast.If) and (name := _looked_into(node.test)):
            looked[name] = min(looked.get(name, node.lineno), node.lineno)
            held |= {name} if locked else set()
        elif isinstance(node, ast.Assign):
            names = {_name(t.value) for t in node.targets if isinstance(t, ast.Subscript)} - {""}
            changed |= names
            held |= names if locked else set()
        if isinstance(node, ast.If | ast.For | ast.While | ast.Try | ast.With):
            locked = locked or isinstance(node, ast.With) and _locks(node)
            inner = [*node.body, *getattr(node, "orelse", []), *getattr(node, "finalbody", []), *(x for h in getattr(node, "handlers", []) for x in h.body)]
            todo += [(x, locked) for x in inner]
    both = looked.keys() & changed
    bare = both - held
    return ("check_then_set", min(looked[x] for x in bare)) if bare else ("guarded_check_then_set", min(looked[x] for x in both)) if both else None


def _calls(function: ast.AST) -> Iterator[tuple[str, str, int]]:
    """Facts about SQL texts and shell commands in a function: kind, how, line."""
    built: dict[str, str] = {}
    inside = _below(function)
    for x in inside:
        if x.__class__ is ast.Assign and len(x.targets) == 1 and _name(x.targets[0]):
            built[_name(x.targets[0])] = _built(x.value)  # the last one stands
    for call in (x for x in inside if x.__class__ is ast.Call and isinstance(x.func, ast.Attribute)):
        command = call.args[0] if call.args else next((k.value for k in call.keywords if k.arg == "args"), None)
        if call.func.attr in SQL_CALLS and call.args:
            how = _built(command) or built.get(_name(command), "")
            if how:
                yield "dynamic_sql", how, call.lineno
            elif len(call.args) > 1 and isinstance(command, ast.Constant) and isinstance(command.value, str) and any(p in command.value for p in PLACEHOLDERS):
                yield "parameterised_sql", "", call.lineno
        if call.func.attr in SHELL_CALLS and command is not None:
            if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords):
                if _built(command) or _name(command):
                    yield "dynamic_shell", _built(command) or "variable", call.lineno
            elif isinstance(command, ast.List):
                yield "listed_command", "", call.lineno


def _facts(path: str, tree: ast.AST, out: list[dict]) -> None:
    """Rows (``fact``) about SQL texts, shell commands and unguarded updates inside functions, with the line that shows each."""
    found = set()
    for function in (x for x in _below(tree) if x.__class__ in FUNCTIONS):
        found |= set(_calls(function))
        if race := _race(function):
            found.add((race[0], "", race[1]))
    out += [{"row": "fact", "path": path, "kind": kind, "name": how, "line": line, "seq": 0} for kind, how, line in sorted(found)]


def _within(rows: list[dict]) -> None:
    """What a file itself says of its references: ``own``, the definition there that each names, and the ``step`` that found it;
    else ``bound``, the last part of what an import bound the first part of the name to. See :func:`references`."""
    full, ends, bound = {}, {}, {}
    for r in rows:
        if r["row"] == "node":
            full[r["qualname"]] = r["source"]  # the last of a full name
            ends.setdefault(r["name"], r["source"])  # the first that ends with a name
        elif r["row"] == "binding":
            bound[r["name"]] = r["target"].rpartition(".")[2]
    for r in rows:
        if r["row"] == "edge" and r["kind"] in ("calls", "inherits"):
            target, last = r["target"], r["target"].rpartition(".")[2]
            if own := full.get(target) or ends.get(target):
                r["own"], r["step"] = own, 1
            elif own := full.get(last) or ends.get(last):
                r["own"], r["step"] = own, 2
            else:
                r["bound"] = bound.get(target.partition(".")[0])


def _parsed_file(path: str, text: str | None, largest: int | None = LARGEST_FILE) -> list[dict]:
    rows: list[dict] = []
    skipped = {"row": "skipped", "path": path, "seq": 0}
    if largest is not None and len((text or "").encode()) > largest:
        return [{**skipped, "kind": "too large"}]
    try:
        tree = ast.parse(text or "")
        _walk(path, tree, rows)
        _within(rows)
        _facts(path, tree, rows)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{**skipped, "kind": "syntax", "line": getattr(e, "lineno", None)}]
    return rows


def _parse(batches: Iterator[pa.RecordBatch], largest: int | None = LARGEST_FILE) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for path, text in zip(batch.column(0), batch.column(1)):
            rows += _parsed_file(path.as_py(), text.as_py(), largest)
            while len(rows) >= BATCH_ROWS:  # a large file's rows go in several
                yield pa.RecordBatch.from_pylist(rows[:BATCH_ROWS], _SCHEMA)
                del rows[:BATCH_ROWS]
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def parse(files: DataFrame, largest: int | None = LARGEST_FILE) -> DataFrame:
    """Rows of ``files(path, text)``: ``row`` is file, node, edge, binding, fact or skipped. A file that doesn't parse, or nests
    deeper than the parser can follow, has one row, ``skipped``; so has one of more than ``largest`` bytes, and with None no file
    is too large. A task needs some 160 bytes for each byte of its largest file.

    Parsing takes far longer than reading, so files are dealt over as many tasks as a shuffle has, however few they were read in.
    They are dealt by a hash of the path: by the path itself Spark would leave the shuffle out after one that has the same key,
    and join that one's small partitions into a single task.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.where("path IS NOT NULL").select("path", "text").repartition(tasks, F.xxhash64("path")).mapInArrow(partial(_parse, largest=largest), ROWS)


def nodes_of(parsed: DataFrame) -> DataFrame:
    """The definitions; of two with one id the later stands."""
    own = parsed.where("row = 'node'")
    told = F.struct("kind", "name", "qualname", "path", "line", "end_line", "signature", "docstring", "is_async")
    return own.groupBy(F.col("source").alias("id")).agg(F.max_by(told, "seq").alias("n")).select("id", "n.*")


def scopes(parsed: DataFrame) -> DataFrame:
    """``path, key, id``: what a name means in its file. A full name means its last definition; a last part alone means the
    first definition that ends with it, unless it is a full name, too."""
    own = parsed.where("row = 'node'").select("path", "seq", F.col("source").alias("id"), F.explode(F.array(F.struct(F.col("qualname").alias("key"), F.lit(True).alias("full")), F.struct(F.col("name").alias("key"), F.lit(False).alias("full")))).alias("k"))
    return own.groupBy("path", F.col("k.key").alias("key")).agg(F.coalesce(F.max_by("id", F.when(F.col("k.full"), F.col("seq"))), F.min_by("id", "seq")).alias("id"))


def references(parsed: DataFrame) -> DataFrame:
    """Calls and base classes ``path, source, qualname, kind, target, line, target_id, step``: the definition that each names.

    Four sets of candidates, the narrowest that has one decides: the name as it stands in the file, its last part there, the only
    definition of what an import bound its first part to, the only definition of its last part anywhere. ``step`` tells which
    (1 to 4). A name that several files define is nobody's, and stays without a ``target_id``.

    The first two are settled where a file is parsed; only what they leave open is shuffled, and names that very many references
    have are dealt over several tasks. Pass a written table, as it is read several times.
    """
    own = parsed.where("row = 'node'").select("path", "seq", F.col("source").alias("id"), F.explode(F.array(F.struct(F.col("qualname").alias("key"), F.lit(True).alias("full")), F.struct(F.col("name").alias("key"), F.lit(False).alias("full")))).alias("k"))
    # in one file: what scopes() says of the name there
    meant = F.coalesce(F.max_by("id", F.when(F.col("k.full"), F.col("seq"))), F.min_by("id", "seq"))
    only = own.groupBy(F.col("k.key").alias("key")).agg(F.min("path").alias("a"), F.max("path").alias("b"), meant.alias("id"))
    only = saved(only.where("a = b").select("key", F.col("id").alias("value")), "only")
    shown = ["path", "source", "qualname", "kind", "target", "line"]
    asked = parsed.where("row = 'edge' AND kind IN ('calls', 'inherits')")
    inside = asked.where("own IS NOT NULL").select(*shown, F.col("own").alias("target_id"), "step")
    left = asked.where("own IS NULL").select(*shown, "bound", F.substring_index("target", ".", -1).alias("last"))
    found = first_known(left, only, ["bound", "last"])
    return inside.unionByName(found.select(*shown, F.col("found").alias("target_id"), (F.col("nth") + 3).alias("step")))


def resolve(parsed: DataFrame) -> DataFrame:
    """``path, qualname, kind, target, line, target_id, resolved`` of each reference; see :func:`references`."""
    return references(parsed).select("path", "qualname", "kind", "target", "line", "target_id", F.col("target_id").isNotNull().alias("resolved"))


def _import_targets(named: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``target_path`` to imports ``(path, name, target)``: the file of the name that is imported, else of its module, else
    of the package around that. Leading dots go up from the importing file's package."""
    modules = files.where(F.col("path").endswith(".py")).groupBy(module_qualname(F.col("path")).alias("module")).agg(F.min("path").alias("file"))
    modules = saved(modules.where("module <> ''").toDF("key", "value"), "modules")
    own = F.split(module_qualname(F.col("path")), r"\.")

    def absolute(name: str) -> Column:
        rest = F.ltrim(F.col(name), F.lit("."))
        dots = F.length(name) - F.length(rest)
        up = dots - F.when(F.col("path").rlike(r"(^|/)__init__\.py$"), 1).otherwise(0)
        package = F.slice(own, F.lit(1), F.greatest(F.size(own) - up, F.lit(0)))
        return F.when(dots > 0, F.array_join(F.filter(F.concat(package, F.array(rest)), lambda x: x != ""), ".")).otherwise(F.col(name))

    named = named.withColumn("_whole", absolute("target")).withColumn("_module", absolute("name")).withColumn("_package", F.left("_module", F.length("_module") - F.length(F.substring_index("_module", ".", -1)) - 1))
    return first_known(named, modules, ["_whole", "_module", "_package"]).withColumnRenamed("found", "target_path")


def resolve_imports(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """``path, target, target_path, resolved``: which of ``files(path)`` each import names.

    A target is a module, or a name in one; what no file answers to is external. Of two files with one module name the smaller
    path counts.
    """
    named = parsed.where("row = 'edge' AND kind = 'imports'").select("path", "name", "target").distinct()
    found = _import_targets(named, files).select("path", "target", "target_path").distinct()
    return found.withColumn("resolved", F.col("target_path").isNotNull())


def code_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, kind, name, qualname, path, line, end_line, signature, docstring, is_async`` and edges ``source, target, kind,
    resolved, line`` of parsed files.

    Files, definitions, and modules that no file answers to (``external``); what contains, calls, inherits, imports and tests
    what. A reference without a definition stays, with its name as the target. A test tests what it calls, unless that is a
    test. Pass a written table, as it is read several times.
    """
    files = parsed.where("row = 'file'").select(F.concat(F.lit("file:"), "path").alias("id"), "kind", "name", module_qualname(F.col("path")).alias("qualname"), "path", "docstring")
    imports = _import_targets(parsed.where("row = 'edge' AND kind = 'imports'").select("path", "source", "name", "target", "line"), files.select("path"))
    outside, inside = F.concat(F.lit("external:"), "name"), F.concat(F.lit("file:"), "target_path")
    external = imports.where("target_path IS NULL").select(outside.alias("id"), F.col("name").alias("qualname")).distinct()
    external = external.select("id", F.lit("external").alias("kind"), F.regexp_extract("qualname", r"([^.]*)$", 1).alias("name"), "qualname", F.lit("").alias("path"), F.lit("").alias("docstring"))
    whole = files.unionByName(external).withColumns({"line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"), "signature": F.lit(""), "is_async": F.lit(None).cast("boolean")})
    nodes = nodes_of(parsed).unionByName(whole)

    resolved = F.col("target_id").isNotNull()
    # an id says what kind of node it is; a test's call of anything but a test is an edge of two kinds
    tests = (F.col("kind") == "calls") & resolved & F.startswith("source", F.lit("test:")) & ~F.startswith("target_id", F.lit("test:"))
    kinds = F.when(tests, F.array("kind", F.lit("tests"))).otherwise(F.array("kind"))
    told = references(parsed).select("source", F.coalesce("target_id", "target").alias("target"), F.explode(kinds).alias("kind"), resolved.alias("resolved"), "line")
    held = parsed.where("row = 'edge' AND kind = 'contains'").select("source", "target", "kind", F.lit(True).alias("resolved"), F.lit(None).cast("int").alias("line"))
    used = imports.select("source", F.coalesce(inside, outside).alias("target"), F.lit("imports").alias("kind"), F.col("target_path").isNotNull().alias("resolved"), "line")
    return nodes, told.unionByName(held).unionByName(used).distinct()


def code_contexts(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, limit: int = 20, max_depth: int = 2) -> DataFrame:
    """The code to look at for each of ``tasks(task_id, task)``: see :func:`graph.contexts_for`. Definitions are found by their
    name, full name, signature and docstring; walks go along everything but imports, also through files."""
    text = F.concat_ws(" ", "name", "qualname", "signature", "docstring")
    place = F.concat(F.col("path"), F.lit(":"), F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 9, "0"))
    known = nodes.select("id", "name", text.alias("text"), F.col("kind").isin(*DEFINITIONS).alias("wanted"), place.alias("place"))
    return contexts_for(known, edges.where("resolved AND kind <> 'imports'"), tasks, limit, max_depth)


def code_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``what, n``: nodes and edges of each kind and in all, edges without a definition, files. Each table is read once."""

    def totals(df: DataFrame, name: str, extra: str, asked: Column) -> DataFrame:
        sums = df.rollup("kind").agg(F.count("*").alias("n"), F.sum(asked.cast("long")).alias("asked"))
        named = F.concat(F.lit(name + "."), F.coalesce("kind", F.lit("total")))
        of_all = F.when(F.col("kind").isNull(), F.lit(extra))
        both = F.array(F.struct(named.alias("what"), F.col("n").alias("n")), F.struct(of_all.alias("what"), F.coalesce("asked", F.lit(0)).alias("n")))
        return sums.select(F.inline(both)).where("what IS NOT NULL")

    return totals(nodes, "nodes", "files", F.col("kind") == "file").unionByName(totals(edges, "edges", "edges.unresolved", ~F.col("resolved")))


def file_risk(nodes: DataFrame, edges: DataFrame, paths: DataFrame, root: str | None = None) -> DataFrame:
    """``unit, tier, reasons, note`` for each of ``paths(path)``, as it is given: how deep a change to the file should be checked.

    A path is brought into the form of the listing first; ``note`` says why nothing in the graph can match it, and then the tier is
    by the path alone and no verdict on the code. Signals: the path's words, the most callers of one definition, files that
    import it, public definitions that no test reaches (callers and tests that aren't resolved are not seen).
    """
    asked = paths.select(F.col("path").alias("unit")).where("unit IS NOT NULL").distinct().withColumn("p", normal_path(F.col("unit"), root)).select("unit", "p.path", "p.note")
    sure = edges.where("resolved")
    callers = sure.where("kind = 'calls'").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("callers"))
    tested = sure.where("kind = 'tests'").select(F.col("target").alias("id"), F.lit(True).alias("tested")).distinct()
    public = F.col("kind").isin("class", "function", "method") & ~F.startswith("name", F.lit("_"))
    own = merged(merged(nodes.where("path <> ''"), callers, "id", "left"), tested, "id", "left")
    own = own.groupBy("path").agg(F.max(F.coalesce("callers", F.lit(0))).alias("callers"), F.sum((public & F.col("tested").isNull()).cast("long")).alias("untested"))
    fan_in = sure.where("kind = 'imports'").groupBy(F.regexp_extract("target", "^file:(.*)$", 1).alias("path")).agg(F.countDistinct("source").alias("fan_in"))
    found = merged(merged(asked, own, "path", "left"), fan_in, "path", "left")
    note = F.coalesce("note", F.when(F.col("callers").isNull(), F.lit("not in the graph")))
    units = found.select("unit", path_signal(F.col("path")).alias("path_marker"), "callers", F.when(F.col("callers").isNotNull(), F.col("fan_in")).alias("fan_in"), "untested", note.alias("note"))
    tiers = risk_tier(units.na.fill(0, ["callers", "fan_in", "untested"]))
    return merged(tiers, units.select("unit", "note"), "unit")


def file_edges(resolved: DataFrame) -> DataFrame:
    """``source, target, kind`` between files, from resolved imports."""
    return resolved.where("resolved AND path <> target_path").select(F.col("path").alias("source"), F.col("target_path").alias("target"), F.lit("imports").alias("kind")).distinct()


def facts(parsed: DataFrame) -> DataFrame:
    """``unit, facts`` of each file that has some."""
    return parsed.where("row = 'fact'").groupBy(F.col("path").alias("unit")).agg(F.array_sort(F.collect_set("kind")).alias("facts"))


def fact_places(parsed: DataFrame) -> DataFrame:
    """``unit, kind, how, line``: where each fact shows, and how."""
    return parsed.where("row = 'fact'").select(F.col("path").alias("unit"), "kind", F.col("name").alias("how"), "line").distinct()


def policy_findings(nodes: DataFrame, edges: DataFrame, policy: DataFrame, application: str, core: str) -> DataFrame:
    """``source, target, from_package, to_package``: resolved imports between files of an application's packages that its
    ``policy(package, allowed)`` doesn't allow; see :func:`rules.policy_breaches`. Files outside the application have no package."""
    own = nodes.where("kind = 'file'").select("id", "path", top_package(F.col("qualname"), application).alias("package")).where("package IS NOT NULL")
    found = policy_breaches(edges.where("kind = 'imports' AND resolved").select("source", "target").distinct(), own.select("id", "package"), policy, core)
    path = lambda c: F.regexp_extract(c, "^file:(.*)$", 1).alias(c)
    return found.select(path("source"), path("target"), "from_package", "to_package")
