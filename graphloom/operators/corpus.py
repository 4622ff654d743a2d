"""Corpus jobs: links, sections, definitions, tags, layers of paths (TX, FN10-FN27, WN10, WN11)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions import paths, text
from graphloom.functions.columns import lookup


def lines_of(corpus: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1."""
    return corpus.select(*keep, F.posexplode(F.split("content", "\n")).alias("_pos", "line")).select(
        *keep, (F.col("_pos") + 1).alias("line_no"), "line"
    )


# Definition patterns per language, as (language, kind, regex); see NAME_FORMS for the name.
DEFINITION_RULES = [
    ("sql", "table", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)"),
    ("sql", "view", r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+[`\"]?(\w+)"),
    ("sql", "index", r"(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"]?(\w+)"),
    ("protobuf", "message", r"^message\s+(\w+)\s*\{"),
    ("protobuf", "enum", r"^enum\s+(\w+)\s*\{"),
    ("protobuf", "service", r"^service\s+(\w+)\s*\{"),
    ("protobuf", "rpc", r"rpc\s+(\w+)\s*\("),
    ("graphql", "type", r"^(?:type|input|enum|interface|union|scalar)\s+(\w+)"),
    ("terraform", "resource", r"^resource\s+\"([^\"]+)\"\s+\"([^\"]+)\"\s*\{"),
    ("terraform", "data", r"^data\s+\"([^\"]+)\"\s+\"([^\"]+)\"\s*\{"),
    ("terraform", "module", r"^module\s+\"([^\"]+)\"\s*\{"),
    ("terraform", "variable", r"^variable\s+\"([^\"]+)\"\s*\{"),
    ("terraform", "output", r"^output\s+\"([^\"]+)\"\s*\{"),
    ("env", "variable", r"^([A-Za-z_][A-Za-z0-9_]*)="),
    ("makefile", "target", r"^([a-zA-Z_.][a-zA-Z0-9_.-]*)(?:\s+.*)?:"),
    ("toml", "section", r"^\s*\[\[?([^\]]+)\]?\]"),
    ("shell", "function", r"^(?:function\s+)?(\w+)\s*\(\s*\)\s*\{?"),
    ("shell", "function", r"^function\s+(\w+)\s*\{"),
    ("dockerfile", "stage", r"(?i)^FROM\s+(\S+)(?:\s+AS\s+(\S+))?"),
]

# Names made of several groups; any other rule names by its first group.
NAME_FORMS = {
    ("terraform", "resource"): lambda one, two: F.concat(one, F.lit("."), two),
    ("terraform", "data"): lambda one, two: F.concat(F.lit("data."), one, F.lit("."), two),
    ("terraform", "module"): lambda one, two: F.concat(F.lit("module."), one),
    # the alias of a stage, else its image without tag and path
    ("dockerfile", "stage"): lambda one, two: F.when(two != "", two).otherwise(
        F.substring_index(F.substring_index(one, ":", 1), "/", -1)),
}

# Lines and names that are no definitions.
SKIPPED_LINES = {"makefile": r":=|\?="}
SKIPPED_NAMES = {"makefile": r"^\.", "graphql": r"^(Query|Mutation|Subscription)$"}


def definitions(corpus: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``(path, kind, name, line_no)`` by table-driven patterns (TX4, UD5);
    Markdown sections come from :func:`sections`."""
    chosen = rules or DEFINITION_RULES
    known = sorted({r[0] for r in chosen})
    rows = lines_of(corpus.filter(F.col("language").isin(known)), "path", "language")
    hits = F.flatten(F.array(*[_finds(lang, kind, rx) for lang, kind, rx in chosen]))
    found = rows.select("path", "language", "line_no", F.inline(F.array_distinct(hits)))
    # a method carries the service that is open at its line; a file is read in order
    order = Window.partitionBy("path").orderBy("line_no")
    methods = found.filter("language = 'protobuf' AND kind IN ('service', 'rpc')").withColumn(
        "service", F.last(F.when(F.col("kind") == "service", F.col("name")), ignorenulls=True).over(order))
    named = methods.filter("kind = 'rpc'").withColumn("name", F.concat_ws(".", "service", "name"))
    plain = found.filter("NOT (language = 'protobuf' AND kind = 'rpc')")
    return plain.select("path", "kind", "name", "line_no").unionByName(named.select("path", "kind", "name", "line_no"))


def graphql_endpoints(corpus: DataFrame) -> DataFrame:
    """``(path, method, name, line_no)``: the fields of the root types (TX4).

    A block opens at the brace after ``type Query``, ``Mutation`` or
    ``Subscription`` and ends with the brace that closes it; the first word of
    each of its lines is an endpoint. A fold over the lines of one document, so
    no shuffle is needed.
    """
    lines = F.split("content", "\n")
    opening = r"^type\s+(Query|Mutation|Subscription)\s*\{"
    count = lambda s, mark: F.length(s) - F.length(F.replace(s, F.lit(mark)))
    none = F.array().cast("array<struct<method:string,name:string,line_no:int>>")

    def step(acc: Column, item: Column) -> Column:
        inside, opened = acc["depth"] > 0, F.regexp_extract(item["line"], opening, 1)
        method = F.when(inside, acc["method"]).otherwise(opened)
        body = F.when(inside, item["line"]).otherwise(F.regexp_replace(item["line"], opening, ""))
        depth = F.when(inside, acc["depth"]).otherwise(1) + count(body, "{") - count(body, "}")
        name = F.regexp_extract(body, r"^\s*(\w+)", 1)
        found = F.struct(method.alias("method"), name.alias("name"), item["line_no"].alias("line_no"))
        return F.when(~inside & (opened == ""), acc).otherwise(F.struct(
            method.alias("method"), F.greatest(F.lit(0), depth).alias("depth"),
            F.when(name != "", F.array_append(acc["out"], found)).otherwise(acc["out"]).alias("out")))

    numbered = F.transform(lines, lambda s, i: F.struct(s.alias("line"), (i + 1).alias("line_no")))
    start = F.struct(F.lit("").alias("method"), F.lit(0).alias("depth"), none.alias("out"))
    return corpus.filter("language = 'graphql'").select(
        "path", F.inline(F.aggregate(numbered, start, step, lambda acc: acc["out"])))


def _finds(lang: str, kind: str, rx: str) -> Column:
    """Every match of one rule in a line, as structs of kind and name."""
    form = NAME_FORMS.get((lang, kind), lambda one, two: one)
    second = F.regexp_extract_all("line", F.lit(rx), F.lit(2)) if re.compile(rx).groups > 1 else None
    names = F.transform(
        F.regexp_extract_all("line", F.lit(rx), F.lit(1)),
        lambda one, i: form(one, F.get(second, i) if second is not None else F.lit("")),
    )
    if lang in SKIPPED_NAMES:
        names = F.filter(names, lambda n: ~n.rlike(SKIPPED_NAMES[lang]))
    here = F.col("language") == lang
    if lang in SKIPPED_LINES:
        here &= ~F.col("line").rlike(SKIPPED_LINES[lang])
    found = F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    return F.when(here, found).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))


def _heading_lines(content: Column) -> Column:
    """Headings outside code fences, as an array of (line_no, level, name).

    A fold over the lines of one document: the fence state is local to it, so
    no shuffle is needed and a document of any length stays one row.
    """
    lines = F.split(content, "\n")

    def step(acc: Column, item: Column) -> Column:
        s, i = item["line"], item["i"]
        mark = F.regexp_extract(s, r"^(```|~~~)", 1)
        opening = (mark != "") & (acc["fence"] == "")
        closing = (acc["fence"] != "") & s.startswith(acc["fence"])
        level = F.length(F.regexp_extract(s, r"^(#{1,6})\s+\S", 1))
        is_head = (acc["fence"] == "") & (mark == "") & (level > 0)
        head = F.struct(
            (i + 1).alias("line_no"), level.alias("level"), F.trim(F.regexp_extract(s, r"^#{1,6}\s+(.+)", 1)).alias("name")
        )
        return F.struct(
            F.when(opening, F.substring(mark, 1, 1)).when(closing & (mark != ""), "").otherwise(acc["fence"]).alias("fence"),
            F.when(is_head, F.array_append(acc["heads"], head)).otherwise(acc["heads"]).alias("heads"),
        )

    empty = F.array().cast("array<struct<line_no:int,level:int,name:string>>")
    start = F.struct(F.lit("").alias("fence"), empty.alias("heads"))
    numbered = F.transform(lines, lambda s, i: F.struct(s.alias("line"), i.alias("i")))
    # only fence and heading lines can change the state
    relevant = F.filter(numbered, lambda x: x["line"].rlike(r"^(```|~~~|#{1,6}\s)"))
    return F.aggregate(relevant, start, step)["heads"]


def sections(corpus: DataFrame) -> DataFrame:
    """Markdown sections with line ranges (WN10, WN11)."""
    rows = corpus.select(
        "path", F.size(F.split("content", "\n")).alias("_n"), _heading_lines(F.col("content")).alias("_h")
    )
    ranged = F.transform(
        "_h",
        lambda h, i: F.struct(
            h["name"].alias("name"), h["level"].alias("level"), h["line_no"].alias("line_start"),
            F.coalesce(F.get(F.col("_h"), i + 1)["line_no"] - 1, F.col("_n")).alias("line_end"),
        ),
    )
    return rows.select("path", F.inline(ranged))


# Entry-point patterns, as (type, description, regex).
ENTRY_POINT_RULES = [
    ("http", "Express/Koa route", r"(?i)(?:app|router|server)\s*\.\s*(?:get|post|put|patch|delete|all|use)\s*\(\s*['\"](/[^'\"]*?)['\"]"),
    ("http", "Decorator route", r"(?i)@(?:app\.)?(?:route|get|post|put|patch|delete|api_view|RequestMapping|GetMapping|PostMapping)\s*\(\s*['\"](/[^'\"]*?)['\"]"),
    ("http", "Exported route handler", r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"),
    ("cli", "CLI command", r"\.command\s*\(\s*['\"]([\w\-:]+)['\"]"),
    ("cli", "argparse subparser", r"add_parser\s*\(\s*['\"]([\w\-]+)['\"]"),
    ("event", "Event listener", r"\.on\s*\(\s*['\"]([\w\-:.]+)['\"]"),
    ("event", "Event subscriber decorator", r"@(?:EventHandler|Subscribe|Listener|on_event)\s*\(\s*['\"]([\w\-:.]+)['\"]"),
    ("cron", "Cron schedule", r"(?i)@?(?:Cron|Schedule|Scheduled|crontab)\s*\(\s*['\"]([^'\"]+)['\"]"),
    ("http", "GraphQL resolver", r"@(?:Query|Mutation|Subscription|Resolver)\s*\("),
    ("http", "gRPC service", r"(?m)^service\s+(\w+)\s*\{"),
    ("manual", "Exported handler", r"export\s+(?:async\s+)?function\s+(handle\w+|process\w+|on\w+)\b"),
]
_TESTS = r"(?:\.test\.|\.spec\.|__tests__|_test\.py|test_\w+\.py)"


def entry_points(corpus: DataFrame) -> DataFrame:
    """Entry points with the line they begin in, tests excluded (TX5). Rules run
    on the whole text, since an argument may stand on the next line."""
    c = F.col("content")
    none = F.array().cast("array<struct<line_no:int,kind:string,description:string,match:string>>")

    def matches(kind: str, description: str, rx: str) -> Column:
        hits = F.regexp_extract_all(c, F.lit(rx), F.lit(0))
        pairs = F.arrays_zip(F.split(c, rx).alias("gap"), hits.alias("hit"))

        def step(acc: Column, p: Column) -> Column:
            line = acc["line"] + paths.newline_count(p["gap"])
            found = F.struct(
                line.cast("int").alias("line_no"), F.lit(kind).alias("kind"), F.lit(description).alias("description"),
                F.substring(p["hit"], 1, 120).alias("match"))
            return F.when(p["hit"].isNull(), acc).otherwise(F.struct(
                (line + paths.newline_count(p["hit"])).cast("int").alias("line"), F.array_append(acc["out"], found).alias("out")))

        start = F.struct(F.lit(1).alias("line"), none.alias("out"))
        return F.when(c.rlike(rx), F.aggregate(pairs, start, step)["out"]).otherwise(none)

    hits = F.concat(*[matches(*rule) for rule in ENTRY_POINT_RULES])
    return corpus.filter(~F.col("path").rlike(_TESTS)).select("path", F.inline(hits))


def articles(corpus: DataFrame) -> DataFrame:
    """Wiki pages -> article rows (TX1)."""
    c = F.col("content")
    links = text.wiki_links(c)
    n = F.size(links)
    return corpus.select(
        F.concat(F.lit("article:"), F.regexp_replace("path", r"\.md$", "")).alias("id"),
        F.coalesce(F.nullif(text.first_heading(c), F.lit("")), paths.stem(F.element_at(F.split("path", "/"), -1))).alias("name"),
        "path",
        text.first_paragraph(c).alias("summary"),
        F.coalesce(text.front_matter_value(c, "tags"), F.lit("")).alias("tags"),
        F.when(n > 15, "complex").when(n > 5, "moderate").otherwise("simple").alias("complexity"),
        n.alias("n_links"),
        F.size(F.regexp_extract_all(c, F.lit(r"(?m)^(#{1,6})\s+(.+)$"), F.lit(1))).alias("n_headings"),
        F.array_join(F.filter(F.regexp_extract_all(c, F.lit(r"(?m)^```(\w+)"), F.lit(1)), lambda x: x != ""), ",").alias("fences"),
        (paths.newline_count(c) + 1).alias("lines"),
        F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))).cast("long").alias("words"),
    )


def article_links(corpus: DataFrame) -> DataFrame:
    """``(path, pos, link)`` for each wiki link (TX1)."""
    return corpus.select("path", F.posexplode(text.wiki_links(F.col("content"))).alias("pos", "link"))


def backlinks(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique link edges and backlink counts (TX2). Backlinks stay in long
    form: a popular page may be the target of a third of all links."""
    edges = resolved.filter("status = 'resolved'").select("source", "target").distinct()
    return edges, edges.groupBy("target").agg(F.count("*").alias("n_backlinks"))


def index_categories(corpus: DataFrame) -> DataFrame:
    """Index pages -> ``(path, category, category_pos, article)`` (TX3). The
    page is cut at its section headings, so members meet their category
    without a window."""
    parts = F.split(F.concat(F.lit("\n"), "content"), r"\n##\s+")
    rows = corpus.select("path", F.posexplode(parts).alias("category_pos", "part")).filter("category_pos > 0")
    return rows.select(
        "path", F.trim(F.split_part("part", F.lit("\n"), F.lit(1))).alias("category"), "category_pos",
        F.explode(text.wiki_links(F.regexp_replace("part", r"\A[^\n]*", ""))).alias("article"),
    )


def log_entries(corpus: DataFrame) -> DataFrame:
    """Dated log headings -> ``(path, date, operation, title)`` (TX3)."""
    rx = r"^##\s+\[(\d{4}-\d{2}-\d{2})\]\s+(\w+)\s*\|\s*(.+)$"
    rows = lines_of(corpus, "path").filter(F.col("line").rlike(rx))
    return rows.select(
        "path", "line_no",
        *[F.trim(F.regexp_extract("line", rx, i)).alias(n) for i, n in enumerate(("date", "operation", "title"), 1)],
    )


def local_references(corpus: DataFrame) -> DataFrame:
    """Markdown links and JSON ``$ref`` to local targets (TX6)."""
    rows = lines_of(corpus, "path")
    link = F.regexp_extract_all("line", F.lit(r"(!?\[[^\]]*\]\([^)]+\))"), F.lit(1))
    md = F.transform(
        link,
        lambda m: F.struct(
            F.regexp_extract(m, r"\]\(([^)]+)\)", 1).alias("target"),
            F.when(m.startswith("!"), "image").otherwise("file").alias("kind"),
        ),
    )
    refs = F.transform(
        F.regexp_extract_all("line", F.lit(r'"\$ref"\s*:\s*"([^"#]+)'), F.lit(1)),
        lambda t: F.struct(t.alias("target"), F.lit("schema").alias("kind")),
    )
    return rows.select("path", "line_no", F.inline(F.concat(md, refs))).filter(~F.col("target").startswith("http"))


def light_signatures(corpus: DataFrame) -> DataFrame:
    """Exports and imports of the head of each file (TX11); the 80-line head
    and the 20 names are what the report is."""
    head = F.array_join(F.slice(F.split("content", "\n"), 1, 80), "\n")
    script = F.regexp_extract_all(
        head,
        F.lit(r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var|interface|type|enum)\s+(\w+)"),
        F.lit(1),
    )
    python = F.regexp_extract_all(head, F.lit(r"(?m)^(?:def|class)\s+(\w+)"), F.lit(1))
    imported = F.regexp_extract_all(
        head, F.lit(r"(import\s+.*?from\s+['\"][^'\"]+['\"]|from\s+[\w.]+\s+import)"), F.lit(1)
    )
    module = F.transform(
        imported,
        lambda m: F.when(m.startswith("import"), F.regexp_extract(m, r"['\"]([^'\"]+)['\"]", 1)).otherwise(
            F.regexp_extract(m, r"from\s+([\w.]+)", 1)
        ),
    )
    return corpus.select(
        "path",
        F.slice(F.when(F.size(script) > 0, script).otherwise(python), 1, 20).alias("exports"),
        F.slice(module, 1, 20).alias("imports"),
        F.size(F.split("content", "\n")).alias("lines"),
    )


def build_graph(files: DataFrame, defs: DataFrame, imports: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File nodes, contained children and their edges (TX10)."""
    # Definition kind -> node type.
    kind_type = {
        "table": "table", "view": "table", "index": "table", "message": "schema", "enum": "schema", "type": "schema",
        "service": "service", "rpc": "endpoint", "stage": "service", "resource": "resource", "data": "resource",
        "module": "module", "variable": "config", "output": "config", "section": "config", "target": "pipeline",
        "function": "function", "class": "class",
    }
    child_type = F.coalesce(lookup(kind_type, F.col("kind")), F.lit("concept"))
    kids = defs.select(
        F.concat_ws(":", child_type, "path", "name").alias("id"), child_type.alias("type"), "name",
        F.col("path").alias("file_path"),
    )
    nodes = (
        files.select(
            F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"),
            F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path"),
        )
        .unionByName(kids).dropDuplicates(["id"])
    )

    def edges(source: Column, target: Column, kind: str, weight: float, df: DataFrame) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))

    file_id = lambda c: F.concat(F.lit("file:"), F.col(c))
    all_edges = (
        edges(file_id("file_path"), F.col("id"), "contains", 1.0, kids)
        .unionByName(edges(file_id("src_path"), file_id("tgt_path"), "imports", 0.7, imports))
        .unionByName(edges(F.col("caller"), F.col("callee"), "calls", 0.8, calls))
        .dropDuplicates(["source", "target", "type"])
    )
    return nodes, all_edges


def detect_layers(nodes: DataFrame) -> DataFrame:
    """Layer of each file node by directory name; default Core (FN11)."""
    ranks = {}
    for rank, (layer, names) in enumerate(dims.LAYER_DIRECTORIES.items()):
        for name in names:
            for form in (name, name + "s"):
                ranks.setdefault(form, f"{rank:02d}{layer}")
    parts = F.split(F.lower(F.translate("file_path", "\\", "/")), "/")
    best = F.array_min(F.filter(F.transform(parts, lambda s: lookup(ranks, s)), lambda r: r.isNotNull()))
    layer = F.coalesce(F.expr("substring(_best, 3)"), F.lit("Core"))
    return (
        nodes.filter("type = 'file'").withColumn("_best", best)
        .select("id", layer.alias("layer_name"), F.concat(F.lit("layer:"), paths.kebab(layer)).alias("layer_id"))
    )


def apply_layers(nodes: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """First layer with a matching path prefix; rest Other (FN12)."""
    path = F.translate("file_path", "\\", "/")
    chosen = F.when(F.col("file_path").isNull(), F.lit("Other"))
    for name, patterns in layers:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | path.startswith(p) | path.contains("/" + p)
        chosen = chosen.when(hit, F.lit(name))
    return nodes.filter("type = 'file'").select("id", chosen.otherwise("Other").alias("layer_name"))


# Label -> directory names.
DIRECTORY_LABELS = {
    "api": ["routes", "api", "controllers", "endpoints", "handlers", "serializers", "controller", "routers", "blueprints"],
    "service": ["services", "core", "lib", "domain", "logic", "signals", "internal", "composables", "mailers", "jobs", "channels"],
    "data": ["models", "db", "data", "persistence", "repository", "entities", "migrations", "entity", "sql", "database", "schema"],
    "ui": ["components", "views", "pages", "ui", "layouts", "screens"],
    "middleware": ["middleware", "plugins", "interceptors", "guards"],
    "utility": ["utils", "helpers", "common", "shared", "tools", "templatetags", "pkg"],
    "config": ["config", "constants", "env", "settings", "management", "commands"],
    "test": ["__tests__", "test", "tests", "spec", "specs"],
    "types": ["types", "interfaces", "schemas", "contracts", "dtos", "dto", "request", "response"],
    "hooks": ["hooks"],
    "state": ["store", "state", "reducers", "actions", "slices"],
    "assets": ["assets", "static", "public"],
    "entry": ["cmd", "bin"],
    "documentation": ["docs", "documentation", "wiki"],
    "infrastructure": ["deploy", "deployment", "infra", "infrastructure", "k8s", "kubernetes", "helm", "charts", "terraform", "tf", "docker"],
    "ci-cd": [".github", ".gitlab", ".circleci"],
}
# File-level label patterns, first match wins.
FILE_LABELS = [
    ("test", r"(\.test\.|\.spec\.)|(^|/)(test_[^/]*\.py|[^/]*_test\.go|[^/]*Test\.java|[^/]*_spec\.rb|[^/]*Test\.php|[^/]*Tests\.cs)$"),
    ("types", r"\.d\.ts$"),
    ("entry", r"(^|/)(index\.ts|index\.js|__init__\.py|Application\.java|Program\.cs|config\.ru)$|^manage\.py$|(^|/)cmd/[^/]+/main\.go$|(^|/)src/(main|lib)\.rs$"),
    ("config", r"(^|/)(wsgi\.py|asgi\.py|Cargo\.toml|go\.mod|Gemfile|pom\.xml|build\.gradle|composer\.json)$"),
    ("infrastructure", r"(^|/)(Dockerfile|docker-compose\.[^/]*|Makefile)$|\.(tf|tfvars)$"),
    ("ci-cd", r"(^|/)\.github/workflows/|(^|/)(\.gitlab-ci\.yml|Jenkinsfile)$"),
    ("data", r"\.sql$"),
    ("types", r"\.(graphql|gql|proto)$"),
    ("documentation", r"\.(md|rst)$"),
]


def directory_label(name: Column) -> Column:
    return lookup(dims.inverted(DIRECTORY_LABELS), F.lower(name))


def file_label(path: Column) -> Column:
    out = F.when(F.lit(False), "")
    for label, rx in FILE_LABELS:
        out = out.when(path.rlike(rx), label)
    return out.otherwise(F.lit(None))


def path_labels(files: DataFrame) -> DataFrame:
    """Pattern label of each file: file-level rule, else nearest labelled directory (FN13)."""
    dirs = F.reverse(F.split(paths.dirname(F.col("path")), "/"))
    by_dir = F.get(F.filter(F.transform(dirs, directory_label), lambda x: x.isNotNull()), F.lit(0))
    return files.select("path", F.coalesce(file_label(F.col("path")), by_dir).alias("label"))


def concepts(nodes: DataFrame, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """``(id, concept)`` by keyword containment in tags and summary (FN14)."""
    words = {**dims.CONCEPT_KEYWORDS, **(extra or {})}
    body = F.lower(F.concat_ws(" ", F.array_join("tags", " "), F.coalesce("summary", F.lit(""))))
    rows = nodes.withColumn("_body", body)
    hits = []
    for concept, keywords in words.items():
        any_word = F.lit(False)
        for k in keywords:
            any_word = any_word | F.col("_body").contains(k.lower())
        hits.append(F.when(any_word, F.lit(concept)))
    return rows.select("id", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("concept"))


def frameworks(manifests: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Frameworks whose keyword occurs in a manifest of the right name (FN15):
    ``manifests(path, content)``, rules of (framework, file name, keyword); those
    of ``dims.FRAMEWORKS`` where none are given."""
    if rules is None:
        rules = [(f, name, word) for f, (names, words) in dims.FRAMEWORKS.items() for name in names for word in words]
    asked: dict[tuple[str, str], list[str]] = {}
    for framework, name, word in rules:
        asked.setdefault((framework, name), []).append(re.escape(word.lower()))
    base = F.element_at(F.split("path", "/"), -1)
    hits = F.array(
        *[
            F.when((base == name) & F.lower("content").rlike("|".join(words)), F.lit(framework))
            for (framework, name), words in asked.items()
        ]
    )
    return manifests.select(F.explode(F.array_distinct(F.filter(hits, lambda h: h.isNotNull()))).alias("framework")).distinct()


def expanded_queries(queries: DataFrame, ring: DataFrame, stemming: bool = True) -> DataFrame:
    """Query variants over synonym groups (FN22): ``queries(query_id, query)``,
    ``ring(group_id, word)``; a query is a short text, so its tokens are few."""
    tokens = queries.select(
        "query_id", F.posexplode(F.split(F.lower("query"), r"\s+")).alias("pos", "token")
    ).withColumn("stem", text.plural_stem(F.col("token")) if stemming else F.col("token"))
    keyed = tokens.select("query_id", "pos", "token", F.explode(F.array_distinct(F.array("token", "stem"))).alias("word"))
    groups = keyed.join(ring, "word").select("query_id", "pos", "token", "group_id").distinct()
    alternatives = groups.join(ring, "group_id").filter("word <> token").select("query_id", "pos", "word").distinct()
    parts = F.split(F.lower("query"), r"\s+")
    swapped = alternatives.join(queries, "query_id").withColumn("_parts", parts).select(
        "query_id",
        F.array_join(
            F.transform("_parts", lambda t, i: F.when(i == F.col("pos"), F.col("word")).otherwise(t)), " "
        ).alias("variant"),
    )
    return swapped.union(queries.select("query_id", F.col("query"))).distinct()


# Default edge weights.
EDGE_WEIGHTS = {
    "contains": 1.0, "imports": 0.7, "calls": 0.8, "inherits": 0.9, "implements": 0.9, "exports": 0.8,
    "depends_on": 0.6, "tested_by": 0.5, "configures": 0.6, "documents": 0.5, "deploys": 0.7, "migrates": 0.7,
    "triggers": 0.6, "defines_schema": 0.8, "serves": 0.7, "provisions": 0.7, "routes": 0.6, "related": 0.5,
}


def default_weights(edges: DataFrame) -> DataFrame:
    """Fill missing weights by edge type, else 0.5 (FN27)."""
    pairs = [F.lit(x) for kv in EDGE_WEIGHTS.items() for x in kv]
    return edges.withColumn(
        "weight", F.coalesce("weight", F.try_element_at(F.create_map(*pairs), F.col("type")), F.lit(0.5))
    )


def complexity_band(non_empty_lines: Column) -> Column:
    return F.when(non_empty_lines < 50, "simple").when(non_empty_lines <= 200, "moderate").otherwise("complex")


def significant(defs: DataFrame) -> DataFrame:
    """Definitions worth a node (FN25): ``defs(kind, n_lines, n_methods, exported)``."""
    return defs.filter(
        F.col("exported")
        | ((F.col("kind") == "function") & (F.col("n_lines") >= 10))
        | ((F.col("kind") == "class") & ((F.col("n_methods") >= 2) | (F.col("n_lines") >= 20)))
    )


# Tag rules on the path, as (tag, regex).
PATH_TAGS = [
    ("test", FILE_LABELS[0][1]),
    ("entry-point", r"(^|/)(manage\.py|Application\.java|Main\.java|Program\.cs|config\.ru)$|(^|/)cmd/([^/]+/)*main\.go$|(^|/)src/(main|lib)\.rs$|(^|/)README\.md$"),
    ("barrel", r"(^|/)mod\.rs$"),
    ("containerization", r"(^|/)Dockerfile[^/]*$"),
    ("infrastructure", r"(^|/)Dockerfile[^/]*$|(^|/)docker-compose\.[^/]*$|\.tf$"),
    ("orchestration", r"(^|/)docker-compose\.[^/]*$"),
    ("ci-cd", r"(^|/)\.github/workflows/"),
    ("deployment", r"(^|/)\.github/workflows/|\.tf$"),
    ("api-schema", r"\.graphql$"),
    ("schema-definition", r"\.(graphql|proto)$"),
    ("data-pipeline", r"\.proto$"),
    ("documentation", r"(^|/)(README|CONTRIBUTING)\.md$"),
    ("development", r"(^|/)CONTRIBUTING\.md$"),
]


def rule_tags(corpus: DataFrame) -> DataFrame:
    """``(path, tag)`` by file name and content rules (FN26)."""
    table = F.col("path").endswith(".sql") & F.col("content").rlike(r"(?i)CREATE\s+TABLE")
    handler = F.col("content").rlike(r"export\s+(?:default\s+)?class\s+\w*(?:Handler|Controller)")
    tags = F.array(
        *[F.when(F.col("path").rlike(rx), F.lit(tag)) for tag, rx in PATH_TAGS],
        F.when(table, F.lit("database")), F.when(table, F.lit("migration")), F.when(handler, F.lit("api-handler")),
    )
    return corpus.select("path", F.explode(F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))).alias("tag"))


def character_vector(rows: DataFrame, key: str = "id", content: str = "content", dim: int = 64) -> DataFrame:
    """Text as an L2-normalised character histogram (FN20).

    Characters are counted before the shuffle, so a text sends at most ``dim``
    rows however long it is.
    """
    chars = rows.select(key, F.explode(F.split(F.lower(content), "")).alias("ch")).filter("ch <> ''")
    counts = chars.groupBy(key, (F.ascii("ch") % dim).alias("code")).agg(F.count("*").cast("double").alias("n"))
    vectors = counts.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("_m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_norm")
    )
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)) / F.col("_norm"),
    )
    return vectors.select(key, filled.alias("vector"))
