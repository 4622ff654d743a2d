"""Enums, alias tables and lookup tables the data model prescribes."""

# Node types.
NODE_TYPES = [
    "file", "function", "class", "module", "concept",
    "config", "document", "service", "table", "endpoint",
    "pipeline", "schema", "resource",
    "domain", "flow", "step",
    "article", "entity", "topic", "claim", "source",
]

# Prefixes an id may carry ("func" is the legacy spelling).
ID_PREFIXES = ["func", *NODE_TYPES]

# Edge category -> edge types.
EDGE_CATEGORIES = {
    "structural": ["imports", "exports", "contains", "inherits", "implements"],
    "behavioral": ["calls", "subscribes", "publishes", "middleware"],
    "data-flow": ["reads_from", "writes_to", "transforms", "validates"],
    "dependencies": ["depends_on", "tested_by", "configures"],
    "semantic": ["related", "similar_to"],
    "infrastructure": ["deploys", "serves", "provisions", "triggers", "migrates", "documents", "routes",
                       "defines_schema"],
    "domain": ["contains_flow", "flow_step", "cross_domain"],
    "knowledge": ["cites", "contradicts", "builds_on", "exemplifies", "categorized_under", "authored_by"],
}
EDGE_TYPES = [t for types in EDGE_CATEGORIES.values() for t in types]

# Node category -> node types.
NODE_CATEGORIES = {
    "code": ["file", "function", "class", "module", "concept"],
    "config": ["config"],
    "docs": ["document"],
    "infra": ["service", "resource", "pipeline"],
    "data": ["table", "endpoint", "schema"],
    "domain": ["domain", "flow", "step"],
    "knowledge": ["article", "entity", "topic", "claim", "source"],
}

# Node type aliases.
NODE_TYPE_ALIASES = {
    "func": "function", "fn": "function", "method": "function",
    "interface": "class", "struct": "class",
    "mod": "module", "pkg": "module", "package": "module",
    "container": "service", "deployment": "service", "pod": "service",
    "doc": "document", "readme": "document", "docs": "document",
    "job": "pipeline", "ci": "pipeline",
    "route": "endpoint", "api": "endpoint", "query": "endpoint", "mutation": "endpoint",
    "setting": "config", "env": "config", "configuration": "config",
    "infra": "resource", "infrastructure": "resource", "terraform": "resource",
    "migration": "table", "database": "table", "db": "table", "view": "table",
    "proto": "schema", "protobuf": "schema", "definition": "schema", "typedef": "schema",
    "business_domain": "domain", "business_flow": "flow", "business_process": "flow",
    "task": "step", "business_step": "step",
    "note": "article", "page": "article", "wiki_page": "article",
    "person": "entity", "actor": "entity", "organization": "entity",
    "tag": "topic", "category": "topic", "theme": "topic",
    "assertion": "claim", "decision": "claim", "thesis": "claim",
    "reference": "source", "raw": "source", "paper": "source",
}

# Edge type aliases.
EDGE_TYPE_ALIASES = {
    "extends": "inherits", "invokes": "calls", "invoke": "calls",
    "uses": "depends_on", "requires": "depends_on",
    "relates_to": "related", "related_to": "related", "similar": "similar_to",
    "import": "imports", "export": "exports", "contain": "contains",
    "publish": "publishes", "subscribe": "subscribes",
    "describes": "documents", "documented_by": "documents",
    "creates": "provisions", "exposes": "serves", "listens": "serves",
    "deploys_to": "deploys", "migrates_to": "migrates", "routes_to": "routes",
    "triggers_on": "triggers", "fires": "triggers", "defines": "defines_schema",
    "has_flow": "contains_flow", "next_step": "flow_step", "interacts_with": "cross_domain",
    "references": "cites", "cites_source": "cites",
    "conflicts_with": "contradicts", "disagrees_with": "contradicts",
    "refines": "builds_on", "elaborates": "builds_on",
    "illustrates": "exemplifies", "instance_of": "exemplifies", "example_of": "exemplifies",
    "belongs_to": "categorized_under", "tagged_with": "categorized_under",
    "written_by": "authored_by", "created_by": "authored_by",
}

# Complexity aliases and valid values.
COMPLEXITIES = ["simple", "moderate", "complex"]
COMPLEXITY_ALIASES = {
    "low": "simple", "easy": "simple",
    "medium": "moderate", "intermediate": "moderate",
    "high": "complex", "hard": "complex", "difficult": "complex",
}

# Edge directions. The merge job knows fewer aliases than the validator.
DIRECTIONS = ["forward", "backward", "bidirectional"]
MERGE_DIRECTION_ALIASES = {"both": "bidirectional", "mutual": "bidirectional"}
DIRECTION_ALIASES = {
    "to": "forward", "outbound": "forward",
    "from": "backward", "inbound": "backward",
    "both": "bidirectional", "mutual": "bidirectional",
}

# Memory lifecycle and its legal transitions.
LIFECYCLES = ["active", "consolidated", "stale", "evicted", "archived"]
TRANSITIONS = {
    "active": ["consolidated", "stale", "evicted", "archived"],
    "consolidated": ["active", "stale", "evicted", "archived"],
    "stale": ["active", "evicted", "archived"],
    "evicted": ["archived"],
    "archived": ["evicted"],
}

# Script-family extensions in pairing priority, mirrored roots.
SCRIPT_EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue"]
MIRROR_ROOTS = ["src", "app", "lib", ""]

# Test-name prefixes and suffixes per extension.
TEST_NAME_RULES = {
    ".go": ([], ["_test"]),
    ".py": (["test_"], ["_test"]),
    ".java": ([], ["Test", "Tests", "IT"]),
    ".kt": ([], ["Test", "Tests"]),
    ".cs": ([], ["Test", "Tests"]),
    ".c": (["test_"], ["_test"]),
    ".cpp": (["test_"], ["_test"]),
    ".cc": (["test_"], ["_test"]),
}

# Extension -> language.
LANGUAGE_EXTS = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".py": "python", ".pyi": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".cs": "csharp", ".swift": "swift", ".lua": "lua", ".rb": "ruby",
    ".rake": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".hxx": "cpp", ".vue": "vue", ".svelte": "svelte", ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".ps1": "powershell", ".psm1": "powershell", ".psd1": "powershell", ".bat": "batch", ".cmd": "batch",
    ".html": "html", ".htm": "html", ".css": "css", ".scss": "css", ".sass": "css", ".less": "css",
    ".md": "markdown", ".mdx": "markdown", ".rst": "markdown", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".jsonc": "jsonc", ".toml": "toml", ".xml": "xml", ".xsl": "xml", ".xsd": "xml", ".plist": "xml",
    ".cfg": "config", ".ini": "config", ".env": "config", ".sql": "sql", ".graphql": "graphql", ".gql": "graphql",
    ".proto": "protobuf", ".prisma": "prisma", ".csv": "csv", ".tsv": "csv", ".tf": "terraform",
    ".tfvars": "terraform", ".gradle": "gradle", ".csproj": "csproj", ".sln": "sln", ".properties": "properties",
    ".mod": "mod", ".sum": "sum",
}

# Language by exact file name.
LANGUAGE_FILENAMES = {
    "Dockerfile": "dockerfile", "Makefile": "makefile", "GNUmakefile": "makefile", "makefile": "makefile",
    "Jenkinsfile": "jenkinsfile", "Procfile": "procfile", "Vagrantfile": "vagrantfile",
}

# Extension -> file category.
CATEGORY_EXTS = {
    ".md": "docs", ".mdx": "docs", ".rst": "docs", ".txt": "docs", ".text": "docs", ".yaml": "config",
    ".yml": "config", ".json": "config", ".jsonc": "config", ".toml": "config", ".xml": "config", ".xsl": "config",
    ".xsd": "config", ".plist": "config", ".cfg": "config", ".ini": "config", ".env": "config",
    ".properties": "config", ".csproj": "config", ".sln": "config", ".mod": "config", ".sum": "config",
    ".gradle": "config", ".tf": "infra", ".tfvars": "infra", ".sql": "data", ".graphql": "data", ".gql": "data",
    ".proto": "data", ".prisma": "data", ".csv": "data", ".tsv": "data", ".sh": "script", ".bash": "script",
    ".zsh": "script", ".ps1": "script", ".psm1": "script", ".psd1": "script", ".bat": "script", ".cmd": "script",
    ".html": "markup", ".htm": "markup", ".css": "markup", ".scss": "markup", ".sass": "markup", ".less": "markup",
}

# File names that are always infrastructure.
INFRA_FILENAMES = [
    "Dockerfile", ".dockerignore", "Makefile", "GNUmakefile", "makefile", "Jenkinsfile", "Procfile",
    "Vagrantfile", ".gitlab-ci.yml", "compose.yml", "compose.yaml",
]

# Layer name -> directory names, first match wins.
LAYER_DIRECTORIES = {
    "API Layer": ["routes", "controller", "handler", "endpoint", "api"],
    "Service Layer": ["service", "usecase", "use-case", "business"],
    "Data Layer": ["model", "entity", "schema", "database", "db", "migration", "repository", "repo"],
    "UI Layer": ["component", "view", "page", "screen", "layout", "widget", "ui"],
    "Middleware Layer": ["middleware", "interceptor", "guard", "filter", "pipe"],
    "External Services": ["client", "integration", "external", "sdk", "vendor", "adapter"],
    "Background Tasks": ["worker", "job", "queue", "cron", "consumer", "processor", "scheduler", "background"],
    "Utility Layer": ["util", "helper", "lib", "common", "shared"],
    "Test Layer": ["test", "spec", "__test__", "__spec__", "__tests__", "__specs__"],
    "Configuration Layer": ["config", "setting", "env"],
}

# Concept -> keywords.
CONCEPT_KEYWORDS = {
    "async/await": ["async", "await", "promise", "asynchronous"],
    "middleware pattern": ["middleware", "interceptor", "pipe"],
    "generics": ["generic", "type parameter", "template"],
    "decorators": ["decorator", "@", "annotation"],
    "dependency injection": ["inject", "provider", "container", "di"],
    "observer pattern": ["subscribe", "publish", "event", "observable", "listener"],
    "singleton": ["singleton", "instance", "shared client"],
    "type guards": ["type guard", "is", "narrowing", "discriminated union"],
    "higher-order functions": ["callback", "factory", "higher-order", "closure"],
    "error handling": ["try/catch", "error boundary", "exception", "Result type"],
    "streams": ["stream", "pipe", "transform", "readable", "writable"],
    "concurrency": ["goroutine", "channel", "thread", "worker", "mutex"],
}

# Personal-data patterns, in scan order.
PII_PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3,4}[-.\s]?\d{4}",
    "creditcard": r"\b(?:\d[ -]*?){13,19}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "apikey": r"\b(?:sk-|pk-|ghp_|api_)[a-zA-Z0-9_-]{20,}\b",
    "url": r"https?://[^\s<>\"']+",
}

# Search source weights.
HYBRID_WEIGHTS = {"bm25": 0.4, "vector": 0.4, "graph": 0.2}


def inverted(groups: dict[str, list[str]]) -> dict[str, str]:
    """member -> group, first group wins."""
    out: dict[str, str] = {}
    for group, members in groups.items():
        for m in members:
            out.setdefault(m, group)
    return out

# Globs that every scan ignores before the user's own rules.
DEFAULT_IGNORES = [
    "node_modules/", ".git/", "vendor/", "venv/", ".venv/", "__pycache__/",
    "dist/", "build/", "out/", "coverage/", ".next/", ".cache/", ".turbo/", "target/", "obj/",
    "*.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.eot", "*.mp3", "*.mp4",
    "*.pdf", "*.zip", "*.tar", "*.gz",
    "*.min.js", "*.min.css", "*.map", "*.generated.*",
    ".idea/", ".vscode/",
    "LICENSE", ".gitignore", ".editorconfig", ".prettierrc", ".eslintrc*", "*.log",
]

# Files that declare the packages of Python projects.
PYTHON_MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile"]
# Frameworks, their manifests and the words that give them away.
FRAMEWORKS = {
    "django": (PYTHON_MANIFESTS, ["django", "djangorestframework", "django-rest-framework", "django-cors-headers", "django-filter"]),
    "fastapi": (PYTHON_MANIFESTS, ["fastapi", "uvicorn", "starlette"]),
    "flask": (PYTHON_MANIFESTS, ["flask", "flask-restful", "flask-sqlalchemy", "flask-marshmallow", "flask-wtf"]),
    "react": (["package.json"], ["react", "react-dom", "@types/react"]),
    "nextjs": (["package.json"], ['"next":', "@next/font", "@next/image"]),
    "express": (["package.json"], ['"express":', "express-validator", "express-session"]),
    "vue": (["package.json"], ["vue", "@vue/cli-service", "nuxt", "vite-plugin-vue"]),
    "spring": (["pom.xml", "build.gradle", "build.gradle.kts"],
               ["spring-boot", "spring-boot-starter", "spring-web", "spring-data", "org.springframework"]),
    "rails": (["Gemfile"], ["rails", "railties", "actionpack", "activerecord", "actionview"]),
    "gin": (["go.mod"], ["github.com/gin-gonic/gin"]),
}
