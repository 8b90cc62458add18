"""Results depend on them, so they are stated as they are."""

# --- fixed values: lines that carry no content, by exact text and by start ---
BOILERPLATE_LINES = (
    "}", ")", "]", "{", "};", "},", "})", "});", "];", "],", "({", "pass", "...", '"""', "'''",
    "return None", "return self", "return True", "return False",
    "if err != nil {", "return nil", "return err", "return nil, err", "return nil, nil", "return fmt.Errorf(",
    "Ok(())", "Ok(());", "Err(e)", "unimplemented!()", "todo!()", "unreachable!()",
    "module.exports", "export default", "'use strict';", '"use strict";', "@Override", "super();", "---",
    "[", "null", "null,", "true,", "false,", "return 0;", "return;", "break;", "continue;",
)
BOILERPLATE_STARTS = (
    "import ", "from ", "use ", "mod ", "require(", "apiVersion:", "kind:", "metadata:", "spec:", "namespace:", "labels:",
    "annotations:", "name:", "resources:", "type: ", "selector:", "template:", "containers:", "ports:", "#include ", "#pragma ",
)

# --- fixed values: weight of a source by the end of its path ---
SOURCE_WEIGHTS = (
    (1.0, (".go", ".py", ".pyw", ".rs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".java", ".kt", ".scala", ".cs", ".fs", ".swift", ".cpp", ".cc", ".c", ".h", ".hpp", ".rb", ".php", ".ex", ".exs", ".dart", ".lua", ".zig")),
    (0.35, (".yaml", ".yml", ".json", ".toml")),
    (0.45, (".md", ".rst", ".txt")),
    (0.40, (".sh", ".bash", ".zsh")),
    (0.75, (".sql",)),
    (0.60, (".html", ".htm", ".css", ".scss", ".vue", ".svelte")),
)
OTHER_SOURCE_WEIGHT = 0.55

# --- fixed values: stop words of queries ---
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "before", "but", "by", "can", "could",
    "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "him", "how", "i", "if", "in", "into", "is", "it",
    "its", "just", "may", "me", "might", "more", "my", "no", "not", "of", "on", "or", "our", "out", "she", "should", "so",
    "some", "that", "the", "them", "then", "there", "they", "this", "to", "up", "us", "was", "we", "were", "what", "when",
    "where", "which", "who", "why", "will", "with", "would", "you", "your",
)

# --- fixed values: verbs that say little, and words that say much, in a query ---
GENERIC_VERBS = (
    "fix", "debug", "add", "help", "check", "look", "find", "show", "get", "make", "do", "run", "try", "use", "change", "update",
    "improve", "understand", "explain", "review", "refactor", "write", "work", "broken", "issue", "problem", "error", "wrong",
)
SPECIFIC_WORDS = (
    "cwe", "sql", "injection", "xss", "token", "auth", "oauth", "jwt", "endpoint", "api", "schema", "migration", "trait", "impl",
    "struct", "async", "await", "cache", "redis", "postgres", "kafka", "docker", "hypothesis", "bisect", "panic", "unwrap",
    "lifetime", "borrow", "memory", "unsafe", "overflow", "deadlock", "race", "lock", "mutex", "latency", "throughput",
    "benchmark", "profil", "optim",
)

# --- fixed values: words of code that are not indexed ---
CODE_STOP_WORDS = (
    "def", "class", "import", "from", "return", "self", "none", "true", "false", "if", "else", "elif", "for", "while", "try",
    "except", "with", "as", "and", "or", "not", "in", "is", "pass", "break", "continue", "yield", "lambda", "raise", "finally",
    "assert", "del", "global", "nonlocal", "fn", "let", "mut", "pub", "use", "mod", "struct", "enum", "impl", "trait", "where",
    "match", "ref", "move", "async", "await", "unsafe", "crate", "super", "type", "const", "static", "var", "new", "this",
    "null", "void", "int", "str", "bool", "the", "are", "but", "was", "all", "any", "can", "had", "her", "his", "how", "its",
    "may", "our", "out", "too", "who", "has", "have", "that", "then", "than", "these", "those", "does", "done",
)
PATH_STOP_WORDS = ("py", "rs", "ts", "js", "md", "txt", "json", "yaml", "yml", "toml", "cfg", "src", "lib", "file")

# --- fixed values: kinds of tasks by words of the query, the first that fits, and their budgets ---
TASKS = (
    ("bug_tracing", 1.5, ("bug", "error", "fail", "crash", "fix", "debug", "trace", "broken")),
    ("refactoring", 1.0, ("refactor", "rename", "move", "extract", "restructure")),
    ("testing", 0.8, ("test", "spec", "assert")),
    ("code_review", 1.0, ("review", "audit", "check")),
    ("code_generation", 0.7, ("create", "implement", "build", "add", "write", "generate")),
    ("documentation", 0.6, ("doc", "readme", "comment")),
    ("exploration", 1.3, ("explore", "understand", "what", "how", "why")),
)

# --- fixed values: names of files by how critical they are ---
SAFETY_FILES = ("license", "license.md", "license.txt", "security.md", "security.txt", "codeowners", "terraform.tfstate", "terraform.tfstate.backup")
CONFIG_FILES = (
    "package.json", "package-lock.json", "requirements.txt", "pyproject.toml", "setup.py", "setup.cfg", "cargo.toml", "cargo.lock",
    "tsconfig.json", "docker-compose.yml", "docker-compose.yaml", "makefile", "cmakelists.txt", "go.mod", "go.sum", ".gitignore",
    ".dockerignore", ".env", ".env.example", ".env.local", "main.tf", "variables.tf", "outputs.tf", "providers.tf",
    "terraform.tfvars", "backend.tf", "chart.yaml", "values.yaml", "values.yml", "kustomization.yaml", "kustomization.yml",
    "program.cs", "startup.cs", "appsettings.json", "package.swift", "podfile", "cartfile",
    "webpack.config.js", "webpack.config.ts", "vite.config.ts", "vite.config.js", "vite.config.mts", "next.config.js",
    "next.config.mjs", "next.config.ts", "next.config.mts", "angular.json", "nuxt.config.ts", "nuxt.config.js", "nuxt.config.mjs",
    "remix.config.js", "remix.config.ts", "svelte.config.js", "svelte.config.ts", "astro.config.mjs", "tailwind.config.js",
    "tailwind.config.ts", "tailwind.config.mjs", "app.vue", "gatsby-config.js", "gatsby-config.ts", "postcss.config.js",
    "postcss.config.mjs", "jest.config.js", "jest.config.ts", "vitest.config.ts", "vitest.config.js", "babel.config.js",
    "babel.config.json", ".babelrc", ".eslintrc.js", ".eslintrc.json", ".eslintrc.cjs", "eslint.config.js", "eslint.config.mjs",
    "prettier.config.js", ".prettierrc", ".prettierrc.json", "dockerfile",
)
TYPE_FILES = ("types.rs", "types.py", "types.ts", "models.py", "schema.py", "schema.rs")
TYPE_ENDS = (".proto", ".graphql", ".schema.json", ".schema.ts", ".d.ts")
INFRASTRUCTURE_ENDS = (".tf", ".hcl")
TEST_ENDS = ("_test.rs", "_test.go", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_spec.rb")
CONTRACT_WORDS = ("interface", "contract", "api")

# --- fixed values: architecture layers by words of a path, lowest first ---
LAYERS = (
    ("domain", ("model", "entity", "domain", "schema", "types")),
    ("data", ("repository", "repo", "store", "dao", "db", "database", "migration")),
    ("service", ("service", "manager", "engine", "provider", "processor", "worker")),
    ("api", ("controller", "handler", "route", "router", "endpoint", "api", "middleware")),
    ("presentation", ("view", "component", "page", "screen", "widget", "ui", "template")),
    ("test", ("test", "spec", "mock", "stub", "fixture")),
)

# --- fixed values: kinds of content, in the order they are asked; pattern and the characters at the start it is sought in (None: all) ---
CONTENT_SIGNS = (
    ("json", r"\A\s*[{\[]", None),
    ("xml", r"\A\s*<", None),
    ("markdown", r"(?m)^#{1,6}\s", 500),
    ("log", r"(?m)^\d{4}[-/]\d{2}|^\[?\d{2}:\d{2}|^(DEBUG|INFO|WARN|ERROR)", 500),
    ("csv", None, None),
    ("table", None, None),
    ("email", r"(?m)^(From|To|Subject|Date):\s", 500),
    ("legal", r"(?i)whereas|hereby|hereinafter|pursuant|notwithstanding", 2000),
    ("stacktrace", r"(?m)(Traceback|Exception|at\s+\S+\.\S+\(|^\s+at\s)", 1000),
)
MAIL_HEADERS = ("From", "To", "Cc", "Bcc", "Subject", "Date", "Reply-To")
FAULT_WORDS = ("Exception", "Error", "Caused by", "Traceback", "panic")

# --- fixed values: words without weight in summaries ---
SUMMARY_STOP_WORDS = (
    "the", "be", "to", "of", "and", "in", "that", "have", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at", "this", "but",
    "his", "by", "from", "they", "we", "say", "her", "she", "or", "an", "will", "my", "one", "all", "would", "there", "their", "what", "so", "up",
    "out", "if", "about", "who", "get", "which", "go", "me", "when", "make", "can", "like", "time", "no", "just", "him", "know", "take", "people", "into",
    "year", "your", "good", "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come", "its", "over", "think", "also", "back", "after",
    "use", "two", "how", "our", "work", "first", "well", "way", "even", "new", "want", "because", "any", "these", "give", "day", "most", "us", "is", "are",
    "was", "were", "been", "has", "had", "did", "does", "am",
)

# --- fixed values: the bits of a fingerprint that make the key of each LSH table, and how many low bits of a key are flipped when probing ---
LSH_PLACES = (
    (0, 19, 20, 21, 40, 41, 42, 61, 62, 63), (2, 3, 4, 5, 24, 25, 26, 45, 46, 47), (7, 8, 9, 10, 29, 30, 31, 50, 51, 52), (12, 13, 14, 15, 34, 35, 36, 55, 56, 57),
    (17, 18, 19, 20, 39, 40, 41, 60, 61, 62), (1, 2, 3, 22, 23, 24, 25, 44, 45, 46), (6, 7, 8, 27, 28, 29, 30, 49, 50, 51), (11, 12, 13, 32, 33, 34, 35, 54, 55, 56),
    (16, 17, 18, 37, 38, 39, 40, 59, 60, 61), (0, 1, 2, 21, 22, 23, 42, 43, 44, 45), (5, 6, 7, 26, 27, 28, 47, 48, 49, 50), (10, 11, 12, 31, 32, 33, 52, 53, 54, 55),
)
LSH_FLIPS = 3
