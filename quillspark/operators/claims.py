"""Checkable claims in texts and their verdicts against a graph."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import folders, normal_path
from ..storage import saved
from .graph import look_up
from .ranking import resemblances

# Results must agree with them.
RELATIONS = {"calls": "calls", "inherits from": "inherits", "extends": "inherits", "imports": "imports"}
NEGATED = {
    "does not call": "calls", "doesn't call": "calls", "never calls": "calls",
    "does not inherit from": "inherits", "doesn't inherit from": "inherits", "never inherits from": "inherits",
    "does not extend": "inherits", "doesn't extend": "inherits", "never extends": "inherits",
    "does not import": "imports", "doesn't import": "imports", "never imports": "imports",
}
NOUNS = ("class", "function", "method", "object")
EXTENSIONS = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".rb", ".md", ".json", ".toml", ".yml", ".yaml", ".txt", ".cfg", ".ini")

CLAIMS = "text_id long, kind string, subject string, relation string, target string, negated boolean"
_WORD, _TARGET, _IDENTIFIER = re.compile(r"[\w.]+"), re.compile(r"[\w./-]+"), re.compile(r"[A-Za-z_]\w*", re.ASCII)


def is_path(token: str) -> bool:
    return "/" in token or token.lower().endswith(EXTENSIONS)


def is_symbol(token: str) -> bool:
    """Dotted identifiers, perhaps called; a plain lower-case word is more often a value or a command than a symbol."""
    name = token.removesuffix("()")
    marked = name != token or "." in name or "_" in name or any(c.isupper() for c in name[1:])
    return marked and all(_IDENTIFIER.fullmatch(x) for x in name.split("."))


def _relation(between: str, known: dict[str, str]) -> str | None:
    """The relation that the words between two quoted names state, if they state one of these."""
    words = between.lower()
    noun = next((x for x in NOUNS if words.lstrip().startswith(x) and words.lstrip()[len(x) :][:1].isspace()), "")
    if not words[-1:].isspace() or not (noun or words[:1].isspace()):
        return None
    return known.get(words.strip().removeprefix(noun).strip())


def claims_in(text: str) -> list[tuple[str, str, str | None, str | None, bool]]:
    """(kind, subject, relation, target, negated): denied relations, then stated ones, then names and paths on their own."""
    return [claim[:5] for claim in _claims(text)]


def _claims(text: str) -> list[tuple[str, str, str | None, str | None, bool, bool]]:
    """The claims of a text, and whether a name on its own stands there as a call.

    The text is cut at its backticks: a piece between two of them may be a quoted name, and the piece after it may state a
    relation to the next. What belongs to a relation is no claim on its own.
    """
    pieces = text.split("`")
    last = len(pieces) - 2  # the last piece with a backtick on both sides
    out: list[tuple[str, str, str | None, str | None, bool, bool]] = []
    taken: list[range] = []
    for known, negated in ((NEGATED, True), (RELATIONS, False)):
        at = 1
        while at + 2 <= last:
            relation = _relation(pieces[at + 1], known) if _WORD.fullmatch(pieces[at]) and _TARGET.fullmatch(pieces[at + 2]) else None
            if relation and not any(at in x and at + 2 in x for x in taken):
                end = at + 2
                while end + 2 <= last and pieces[end + 1].split() == ["and"] and pieces[end + 1][-1].isspace() and _TARGET.fullmatch(pieces[end + 2]):
                    end += 2
                out += [("symbol_relation", pieces[at], relation, pieces[k], negated, False) for k in range(at + 2, end + 1, 2)]
                taken.append(range(at, end + 1))
            at += 4 if relation else 1
    at = 1
    while at <= last:
        token = pieces[at].strip()
        if not any(at in x for x in taken):
            if token and is_path(token):
                out.append(("file_exists", token, None, None, False, False))
            elif is_symbol(token):
                out.append(("symbol_exists", token.removesuffix("()"), None, None, False, token.endswith("()")))
        at += 2 if pieces[at] else 1  # an empty piece is no quotation
    return out


_NAMES = [x.split()[0] for x in CLAIMS.split(", ")] + ["called"]
_CLAIM = pa.schema([("text_id", pa.int64()), *((n, pa.string()) for n in _NAMES[1:5]), ("negated", pa.bool_()), ("called", pa.bool_())])


def _extract_called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [dict(zip(_NAMES, (i, *claim))) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for claim in _claims(text or "")]
        yield pa.RecordBatch.from_pylist(rows, _CLAIM)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _extract_called(batches):
        yield batch.drop_columns(["called"])


def extract(texts: DataFrame) -> DataFrame:
    """The claims of ``texts(text_id, text)``."""
    return texts.select(F.col("text_id").cast("long"), "text").mapInArrow(_extract, CLAIMS)


def _path(name: Column) -> Column:
    return F.contains(name, F.lit("/")) | F.lower(name).rlike("(" + "|".join(x.replace(".", "\\.") for x in EXTENSIONS) + ")$")


def inside(path: Column) -> Column:
    """A path below the root without ``.``, ``..`` and doubled slashes, also if it begins with a slash; null if it leads out."""
    found = normal_path(F.ltrim(path, F.lit("/")))
    return F.when(found["note"].isNull(), found["path"])


def verdicts(claims: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Each claim with ``status`` and ``confidence``.

    Given are ``nodes(name, path)``, ``edges(source, target, kind, resolved)`` by name, ``files(path)`` and, between
    files, ``imports(source, target)``. A relation to a name that isn't resolved can't be verified; nor can a call of a
    file that is imported, since an import is no call. Only files import. A denial turns supported into contradicted and
    back. Without ``imports`` no file imports another.
    """
    path = F.col("path") if "path" in nodes.columns else F.lit(None).cast("string")
    named = nodes.groupBy("name").agg(F.collect_set(path).alias("paths"))
    listed = files.select("path").distinct()
    pairs = (edges.sparkSession.createDataFrame([], "source string, target string") if imports is None else imports).select("source", "target").distinct()
    tail = lambda x: F.regexp_extract(x, r"([^.]*)$", 1)
    sure = edges.where("resolved").groupBy("source", "kind", "target").agg(F.lit(True).alias("edge"))
    open_ends = edges.where("NOT resolved").select("source", "kind", tail(F.col("target")).alias("tail")).distinct()

    c = claims.withColumn("claim", F.struct(*claims.columns)).select("claim", F.col("claim.subject").alias("subject"), F.col("claim.relation").alias("relation"), F.col("claim.target").alias("target"))
    c = c.withColumn("place", F.when(F.col("claim.kind") == "file_exists", inside(F.col("subject"))).otherwise(F.col("subject")))
    c = c.join(named.select(F.col("name").alias("subject"), "paths"), "subject", "left")
    c = c.join(nodes.select(F.col("name").alias("target"), F.lit(True).alias("to_symbol")).distinct(), "target", "left")
    c = c.join(listed.select(F.col("path").alias("place"), F.lit(True).alias("from_file")), "place", "left")
    c = c.join(listed.select(F.col("path").alias("target"), F.lit(True).alias("to_file")), "target", "left")
    c = c.join(sure.toDF("subject", "relation", "target", "edge"), ["subject", "relation", "target"], "left")
    c = c.withColumn("tail", tail(F.col("target"))).join(open_ends.toDF("subject", "relation", "tail").withColumn("open_end", F.lit(True)), ["subject", "relation", "tail"], "left")
    imported = pairs.groupBy("target").agg(F.collect_set("source").alias("importers"))
    c = c.join(imported, "target", "left")

    yes = lambda name: F.col(name).isNotNull()
    verdict = lambda status, confidence: F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))
    no, supported, unsure = verdict("contradicted", 1.0), verdict("supported", 1.0), verdict("unverifiable", 0.0)
    importers = F.coalesce("importers", F.array().cast("array<string>"))
    by_import = F.when(~_path(F.col("subject")), unsure).when(~yes("from_file") | ~yes("to_file"), no).when(F.array_contains(importers, F.col("subject")), supported).otherwise(no)
    to_file = F.when(~yes("paths") | ~yes("to_file"), no).when(F.arrays_overlap("paths", importers), unsure).otherwise(verdict("contradicted", 0.9))
    to_symbol = F.when(~yes("paths") | ~yes("to_symbol"), no).when(yes("edge"), supported).when(yes("open_end"), unsure).otherwise(verdict("contradicted", 0.9))
    found = (
        F.when(F.col("claim.kind") == "file_exists", F.when(yes("from_file"), supported).otherwise(no))
        .when(F.col("claim.kind") == "symbol_exists", F.when(yes("paths"), supported).otherwise(no))
        .when(F.col("relation") == "imports", by_import)
        .when(_path(F.col("target")), to_file)
        .otherwise(to_symbol)
    )
    status = F.col("found.status")
    turned = F.when(~F.col("claim.negated"), status).when(status == "supported", "contradicted").when(status == "contradicted", "supported").otherwise(status)
    return c.withColumn("found", found).select("claim.*", turned.alias("status"), F.col("found.confidence").alias("confidence"))

#: Why a claim has its status, in words; ``{n}`` and the like are filled in.
EXPLANATIONS = {
    "defined": "{n} definition(s) found",
    "undefined": "no definition of '{subject}' found in the graph",
    "bare": "no definition of '{subject}' found in the graph (it may be a local variable, which the graph doesn't hold)",
    "no subject": "no definition of '{subject}' found",
    "no target": "'{subject}' is defined, '{target}' is not",
    "edge": "a resolved {relation} edge connects them",
    "open edge": "a {relation} edge to an unresolved '{target}' can't be told from this target",
    "no edge": "both are defined, but no {relation} edge connects them",
    "no file": "no file at '{target}' in the graph",
    "no own file": "no file at '{subject}' in the graph",
    "import is no call": "a file that defines '{subject}' imports '{target}', but an import is no call",
    "no import of the target": "no file that defines '{subject}' imports '{target}'",
    "imports": "'{subject}' imports '{target}'",
    "imports not": "'{subject}' does not import '{target}'",
    "not a file": "only files import, and '{subject}' does not look like one",
    "exists": "file exists",
    "missing": "no file at '{subject}'",
    "outside": "the path leads out of the root",
    "no graph": "no code graph given",
    "no listing": "no listing of files given",
}
_SUPPORTED, _CONTRADICTED, _UNSURE = ("defined", "edge", "imports", "exists"), ("undefined", "bare", "no subject", "no target", "no file", "no own file", "imports not", "missing", "outside"), ("open edge", "import is no call", "not a file", "no graph", "no listing")
CHECKS = ("text_id", "kind", "subject", "relation", "target", "negated", "status", "confidence", "explanation", "evidence")


def _located(nodes: DataFrame) -> Column:
    return F.when(F.col("line").isNotNull(), F.concat("path", F.lit(":"), F.col("line").cast("string"))).otherwise(F.col("path"))


def _codes(asks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ask, code, n, evidence`` of symbol claims and relations ``asks(ask, kind, subject, relation, target, called)`` by a code graph."""
    to_path = _path(F.col("target"))
    wanted = asks.where("kind = 'symbol_exists' OR relation <> 'imports'").select(F.col("subject").alias("wanted")).unionByName(asks.where(F.col("kind") == "symbol_relation").where((F.col("relation") != "imports") & ~to_path).select(F.col("target").alias("wanted")))
    placed = nodes.select("id", "path", "line", _located(nodes).alias("at"))
    found = saved(look_up(nodes, wanted).join(placed, "id"), "meanings")
    defined = found.groupBy("wanted").agg(F.count("*").alias("n"), F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "at")))), lambda x: x["at"]), 1, 5).alias("evidence"))

    # ways from what the subject may mean to what the target may mean
    relations = asks.where((F.col("kind") == "symbol_relation") & (F.col("relation") != "imports"))
    last = lambda c: F.regexp_extract(c, r"([^.]*)$", 1)
    mine = relations.join(found.select(F.col("wanted").alias("subject"), F.col("id").alias("source"), "place", "at", F.col("path").alias("own")), "subject")
    out = edges.select("source", F.col("kind").alias("relation"), F.col("target").alias("to"), "resolved")
    ends = mine.where(~to_path).join(out, ["source", "relation"])
    sure = ends.where("resolved").join(found.select(F.col("wanted").alias("target"), F.col("id").alias("to")), ["target", "to"]).groupBy("ask").agg(F.min_by("at", "place").alias("edge_at"))
    maybe = ends.where(~F.col("resolved") & (last(F.col("to")) == last(F.col("target")))).select("ask", F.lit(True).alias("open_end")).distinct()
    files = nodes.where("kind = 'file'").select("path").distinct()
    uses = edges.where("kind = 'imports' AND resolved").select(F.regexp_extract("source", "^file:(.*)$", 1).alias("own"), F.regexp_extract("target", "^file:(.*)$", 1).alias("target")).distinct()
    used = mine.where(to_path).select("ask", "own", "target").join(uses, ["own", "target"]).select("ask", F.lit(True).alias("imported")).distinct()
    direct = asks.where("relation = 'imports'").select("ask", F.col("subject").alias("own"), "target").join(uses, ["own", "target"]).select("ask", F.lit(True).alias("direct"))

    a = asks.join(defined.withColumnRenamed("wanted", "subject"), "subject", "left")
    a = a.join(found.select(F.col("wanted").alias("target"), F.lit(True).alias("to_symbol")).distinct(), "target", "left")
    a = a.join(files.toDF("target").withColumn("to_file", F.lit(True)), "target", "left").join(files.toDF("subject").withColumn("from_file", F.lit(True)), "subject", "left")
    for more in (sure, maybe, used, direct):
        a = a.join(more, "ask", "left")
    yes = lambda name: F.col(name).isNotNull()
    bare = ~F.contains("subject", F.lit(".")) & ~F.col("called") & (F.lower("subject") == F.col("subject"))
    exists = F.when(yes("n"), "defined").when(bare, "bare").otherwise("undefined")
    by_import = F.when(~_path(F.col("subject")), "not a file").when(~yes("from_file"), "no own file").when(~yes("to_file"), "no file").when(yes("direct"), "imports").otherwise("imports not")
    by_file = F.when(~yes("n"), "no subject").when(~yes("to_file"), "no file").when(yes("imported"), "import is no call").otherwise("no import of the target")
    by_edge = F.when(~yes("n"), "no subject").when(~yes("to_symbol"), "no target").when(yes("edge_at"), "edge").when(yes("open_end"), "open edge").otherwise("no edge")
    code = F.when(F.col("kind") == "symbol_exists", exists).when(F.col("relation") == "imports", by_import).when(to_path, by_file).otherwise(by_edge)
    a = a.withColumn("code", code)
    none = F.array().cast("array<string>")
    evidence = F.when(F.col("code") == "defined", F.col("evidence")).when(F.col("code") == "edge", F.array("edge_at")).when(F.col("code") == "imports", F.array("subject")).otherwise(none)
    return a.select("ask", "code", F.coalesce("n", F.lit(0)).alias("n"), evidence.alias("evidence"))


def check(texts: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, files: DataFrame | None = None, decisions: DataFrame | None = None, constraints: DataFrame | None = None) -> DataFrame:
    """Every claim of ``texts(text_id, text)`` with a status, a confidence, an explanation and up to five places as evidence, and
    what resembles decisions that are no longer taken or hard constraints.

    ``nodes`` and ``edges`` are a code graph (:func:`codegraph.code_graph`), ``files(path)`` a listing below the root. Claims on what
    isn't given are unverifiable, never left out. A denial turns the status. ``decisions(id, statement, detail, status)`` count if
    they are rejected or superseded, ``constraints(id, statement, hard)`` if they are hard; a resemblance contradicts, with a
    confidence below 1, as ``decision_alignment`` and with the record's id as evidence. Equal claims of a text stay apart.
    """
    texts = texts.select(F.col("text_id").cast("long").alias("text_id"), "text")
    ask = F.sha2(F.to_json(F.struct("kind", "subject", "relation", "target", "called")), 256)
    claims = saved(texts.mapInArrow(_extract_called, f"{CLAIMS}, called boolean").withColumn("ask", ask), "claims")
    asks = claims.select("ask", "kind", "subject", "relation", "target", "called").distinct()
    symbols, paths = asks.where("kind <> 'file_exists'"), asks.where("kind = 'file_exists'")
    none = F.array().cast("array<string>")
    unknown = lambda df, code: df.select("ask", F.lit(code).alias("code"), F.lit(0).cast("long").alias("n"), none.alias("evidence"))
    told = unknown(symbols, "no graph") if nodes is None or edges is None else _codes(symbols, nodes, edges)
    if files is None:
        listed = unknown(paths, "no listing")
    else:
        places = files.select(F.explode(F.array_append(folders(F.col("path")), F.col("path"))).alias("place")).distinct().withColumn("there", F.lit(True))
        placed = paths.withColumn("place", inside(F.col("subject"))).join(places, "place", "left")
        code = F.when(F.col("place").isNull(), "outside").when(F.col("there"), "exists").otherwise("missing")
        listed = placed.select("ask", code.alias("code"), F.lit(0).cast("long").alias("n"), F.when(F.col("there"), F.array("subject")).otherwise(none).alias("evidence"))

    found = claims.join(told.unionByName(listed), "ask")
    status = F.when(F.col("code").isin(*_SUPPORTED), "supported").when(F.col("code").isin(*_UNSURE), "unverifiable").otherwise("contradicted")
    turned = F.when(~F.col("negated"), status).when(status == "supported", "contradicted").when(status == "contradicted", "supported").otherwise(status)
    confidence = F.when(F.col("code").isin(*_UNSURE), 0.0).when(F.col("code").isin(*_SUPPORTED, *_CONTRADICTED), 1.0).otherwise(0.9)
    words = F.create_map(*[F.lit(x) for pair in EXPLANATIONS.items() for x in pair])[F.col("code")]
    for name in ("subject", "relation", "target", "n"):
        words = F.replace(words, F.lit("{" + name + "}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    denied = F.when(F.col("negated") & (status != "unverifiable"), F.when(status == "supported", "the denial is false: ").otherwise("the denial holds: ")).otherwise("")
    out = found.select("text_id", "kind", "subject", "relation", "target", "negated", turned.alias("status"), confidence.alias("confidence"), F.concat(denied, words).alias("explanation"), "evidence")

    for records, what in ((decisions, "decision"), (constraints, "constraint")):
        if records is not None:
            out = out.unionByName(_resembled(texts, records, what))
    return out.select(*CHECKS)


def _resembled(texts: DataFrame, records: DataFrame, what: str) -> DataFrame:
    dead = F.col("status").isin("rejected", "superseded") if what == "decision" else F.col("hard")
    records = records.where(dead)
    why = F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise("") if what == "decision" else F.lit("")
    said = F.concat(F.lit("resembles a "), "status", F.lit(" decision: '"), "statement", F.lit("'"), why) if what == "decision" else F.concat(F.lit("resembles a breach of a hard constraint: '"), "statement", F.lit("'"))
    near = resemblances(texts.select(F.col("text_id").alias("query_id"), F.col("text").alias("query")), records.select(F.col("id").alias("doc_id"), F.col("statement").alias("text")))
    named = records.select(F.col("id").alias("doc_id"), "statement", said.alias("explanation"))
    nothing = F.lit(None).cast("string")
    return near.join(named, "doc_id").select(
        F.col("query_id").alias("text_id"), F.lit("decision_alignment").alias("kind"), F.col("statement").alias("subject"), nothing.alias("relation"), nothing.alias("target"), F.lit(False).alias("negated"),
        F.lit("contradicted").alias("status"), "confidence", "explanation", F.array(F.col("doc_id").cast("string")).alias("evidence"),
    )


def reports(texts: DataFrame, checks: DataFrame, graph: bool = True, memory: bool = True) -> DataFrame:
    """``text_id, claims_extracted, supported, contradicted, unverifiable, resembled, degraded_reason`` for each text, also without
    claims; ``graph`` and ``memory`` say what the checks had."""
    n = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    own = F.col("kind") != "decision_alignment"
    sums = checks.groupBy("text_id").agg(n(own).alias("claims_extracted"), *[n(own & (F.col("status") == s)).alias(s) for s in ("supported", "contradicted", "unverifiable")], n(~own).alias("resembled"))
    lost = [x for x, there in (("no code graph given: symbols and relations can't be verified", graph), ("no memory given: decisions and constraints aren't checked", memory)) if not there]
    out = texts.select(F.col("text_id").cast("long").alias("text_id")).distinct().join(sums, "text_id", "left").na.fill(0)
    return out.withColumn("degraded_reason", F.lit("; ".join(lost) if lost else None).cast("string"))


def resurfacings(checks: DataFrame) -> DataFrame:
    """Log records for the decisions that texts resembled: surfaced, and not heeded. Their id is made from text and decision, so an
    upsert of the same rows changes nothing."""
    hits = checks.where("kind = 'decision_alignment' AND explanation LIKE 'resembles a % decision:%'")
    record = F.element_at("evidence", 1)
    return hits.select(F.sha2(F.concat_ws(":", F.lit("decision_resurfacing"), "text_id", record), 256).alias("id"), F.lit("surfacing").alias("record_type"), F.lit("decision_resurfacing").alias("surfaced_via"), F.array(record.cast("long")).alias("record_ids"), F.lit(False).alias("used")).distinct()
