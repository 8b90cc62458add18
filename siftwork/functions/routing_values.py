"""Fixed values of routing: words and patterns that tell what a prompt or a command is about, in the order they are asked."""

# --- fixed values: intents by words of a question ---
INTENTS = (
    ("release", ("release", "deploy", "rollout", "ready to ship", "changelog", "version")),
    ("pr_brief", ("pr", "pull request", "diff", "review", "merge", "commit")),
    ("code_generation", ("generate", "write code", "implement", "scaffold", "create function", "migration")),
    ("report", ("report", "slide", "presentation", "diagram", "chart", "visuali")),
    ("research", ("research", "benchmark", "compare", "evaluate", "study", "analyze options")),
    ("architecture", ("architecture", "design", "how does", "system", "module", "component", "dependency", "flow", "pipeline")),
    ("reuse", ("reuse", "existing", "already have", "duplicate", "shared", "utility", "helper")),
    ("onboarding", ("onboard", "explain", "new engineer", "getting started", "walkthrough", "tutorial")),
)
# --- fixed values: risk of a question by its words ---
QUESTION_RISKS = (
    ("high", ("security", "vulnerability", "pii", "compliance", "audit", "gdpr", "hipaa", "credential", "secret", "encrypt", "auth")),
    ("medium", ("deploy", "migration", "database", "schema", "release", "production", "breaking", "api change")),
)
# --- fixed values: risk of a prompt's domain by its words ---
DOMAIN_RISKS = (
    ("high", ("security", "auth", "authentication", "password", "secret", "credential", "payment", "billing", "encrypt", "decrypt", "token", "vulnerability", "injection", "sanitize")),
    ("low", ("explain", "what is", "how does", "summarize", "describe", "chat", "hello")),
)
# --- fixed values: archetypes of prompts, by patterns without regard to case ---
ARCHETYPES = (
    ("test/run", r"\b(?:pytest|jest|vitest|mocha|rspec|phpunit)\b"),
    ("test/run", r"\b(?:run|execute)\b.*\b(?:test|spec|suite)\b"),
    ("test/write", r"\b(?:write|add|create)\b.*\b(?:test|spec|unit test)\b"),
    ("test/fix", r"\b(?:fix|debug|failing)\b.*\btest\b"),
    ("build/run", r"\b(?:build|compile|tsc|webpack|cargo build|go build|make)\b"),
    ("build/fix", r"\b(?:fix|resolve)\b.*\b(?:build|compilation|type)\s*(?:error|issue)\b"),
    ("lint/run", r"\b(?:lint|eslint|pylint|ruff|clippy|format|prettier|black)\b"),
    ("typecheck/run", r"\b(?:mypy|pyright|typecheck|type.?check|tsc.*noEmit)\b"),
    ("code/refactor", r"\b(?:refactor|rename|move|extract|inline)\b"),
    ("code/implement", r"\b(?:add|implement|create|write)\b.*\b(?:function|method|class|component|endpoint)\b"),
    ("code/fix_bug", r"\b(?:fix|debug|resolve|patch)\b.*\b(?:bug|error|issue|crash|exception)\b"),
    ("code/edit", r"\b(?:update|change|modify|edit)\b"),
    ("explain", r"\b(?:explain|what does|how does|why does|what is|describe|summarize)\b"),
    ("inspect", r"\b(?:read|look at|check|review|show|find|search|grep)\b"),
    ("git/op", r"\b(?:git|commit|push|pull|merge|rebase|branch|diff|status)\b"),
    ("setup", r"\b(?:install|setup|configure|init|npm|pip|cargo)\b"),
)
# --- fixed values: profiles of tasks, by patterns without regard to case ---
TASK_PROFILES = (
    ("Debugging", r"\b(fix|bug|error|crash|issue|debug|broken|fail|wrong|exception)\b"),
    ("Feature", r"\b(add|implement|create|build|feature|new|support|integrate|enable)\b"),
    ("Refactoring", r"\b(refactor|clean|reorganize|simplify|extract|rename|move|split|merge)\b"),
    ("Performance", r"\b(optimize|performance|slow|fast|speed|cache|memory|leak|bottleneck)\b"),
    ("Testing", r"\b(test|spec|assert|expect|mock|stub|coverage|unit|integration|e2e)\b"),
    ("Documentation", r"\b(document|readme|comment|explain|describe|usage|api)\b"),
)
# --- fixed values: steps that need no model, by patterns without regard to case; kind, executor, verifier, confidence ---
SUBSTEPS = (
    ("computation", "sympy", "exact", 0.7, (
        r"\b(?:calculate|compute|evaluate|solve|simplify|factor|expand|integrate|differentiate|derive)\b",
        r"\b(?:what is|how much is|find the value of)\s+[\d\.\+\-\*\/\(\)\^\s]+",
        r"(?:^|\s)[\d]+\s*[\+\-\*\/\^]\s*[\d]+",
        r"\b(?:average|mean|median|mode|std|variance|sum of|product of)\b",
        r"\b(?:convert|how many)\s+\w+\s+(?:to|in|per)\s+\w+",
    )),
    ("code_inspection", "ast", "structural", 0.6, (
        r"\b(?:what (?:does|is)|show me|list|find)\s+(?:the\s+)?(?:function|method|class|signature|parameters|arguments|return type|imports|dependencies)",
        r"\b(?:how many|count)\s+(?:functions|methods|classes|lines|arguments|parameters)\b",
        r"\b(?:what (?:does|is))\s+\w+\s*\(",
        r"\b(?:call graph|dependency graph|import graph|type of|signature of)\b",
        r"\blist\s+(?:the\s+)?(?:functions|methods|classes|imports)",
    )),
    ("test_execution", "test_runner", "exit_code", 0.8, (
        r"\b(?:run|execute)\s+(?:the\s+)?(?:tests?|test suite|pytest|unittest|cargo test|npm test|jest|mocha)\b",
        r"\b(?:does|do|will)\s+(?:the\s+)?tests?\s+(?:pass|fail|succeed)\b",
        r"\b(?:does|do|will)\s+(?:the\s+)?test\s+suite\s+(?:pass|fail|succeed)\b",
        r"\b(?:check if|verify that|make sure)\s+.*\b(?:compiles?|builds?|passes?)\b",
    )),
    ("retrieval_claim", "retrieval", "citation", 0.5, (
        r"\b(?:according to|as stated in|based on|from the)\s+(?:the\s+)?(?:docs?|documentation|readme|api|spec|specification|source)\b",
        r"\b(?:what does the (?:docs?|documentation|readme|api) say about)\b",
        r"\b(?:is it true that|verify that|confirm that|check whether)\b",
        r"\b(?:look up|find in|search for)\s+.*\b(?:in the|from the)\b",
    )),
)
# --- fixed values: commands by what they do: category, tool, pattern, and a pattern that excludes ---
COMMANDS = (
    ("test", "pytest", r"\bpytest\b|python\s+-m\s+pytest\b|py\.test\b", None),
    ("test", "unittest", r"\bunittest\b|python\s+-m\s+unittest\b", None),
    ("test", "nose", r"\bnose2?\b|python\s+-m\s+nose\b", None),
    ("test", "jest", r"\bjest\b|npx\s+jest\b", None),
    ("test", "vitest", r"\bvitest\b|npx\s+vitest\b", None),
    ("test", "mocha", r"\bmocha\b|npx\s+mocha\b", None),
    ("test", "cypress", r"\bcypress\b|npx\s+cypress\b", None),
    ("test", "playwright", r"\bplaywright\b|npx\s+playwright\b", None),
    ("test", "go_test", r"\bgo\s+test\b", None),
    ("test", "cargo_test", r"\bcargo\s+test\b", None),
    ("test", "dotnet_test", r"\bdotnet\s+test\b", None),
    ("test", "rspec", r"\brspec\b|bundle\s+exec\s+rspec\b", None),
    ("test", "phpunit", r"\bphpunit\b", None),
    ("test", "maven_test", r"\bmaven\s+test\b|mvn\s+test\b", None),
    ("test", "gradle_test", r"\bgradle\s+test\b|gradlew\s+test\b", None),
    ("test", "npm_test", r"\bnpm\s+(?:run\s+)?test\b|yarn\s+(?:run\s+)?test\b|pnpm\s+test\b", None),
    ("test", "zig_test", r"\bzig\s+test\b", None),
    ("test", "swift_test", r"\bswift\s+test\b", None),
    ("test", "mix_test", r"\belixir.*test\b|mix\s+test\b", None),
    ("build", "cargo_build", r"\bcargo\s+build\b", None),
    ("build", "go_build", r"\bgo\s+build\b", None),
    ("build", "npm_build", r"\bnpm\s+run\s+build\b|yarn\s+build\b|pnpm\s+build\b", None),
    ("build", "tsc_build", r"\btsc\b", r"\btsc\b.*--noEmit"),
    ("build", "webpack", r"\bwebpack\b", None),
    ("build", "vite_build", r"\bvite\s+build\b", None),
    ("build", "make", r"\bmake\b", r"\bmake\b\s+test"),
    ("build", "cmake", r"\bcmake\b", None),
    ("build", "cc", r"\bgcc\b|g\+\+\b|clang\b|clang\+\+\b", None),
    ("build", "javac", r"\bjavac\b", None),
    ("build", "dotnet_build", r"\bdotnet\s+build\b", None),
    ("build", "zig_build", r"\bzig\s+build\b", None),
    ("lint", "ruff", r"\bruff\b(?:\s+check)?", None),
    ("lint", "eslint", r"\beslint\b|npx\s+eslint\b", None),
    ("lint", "pylint", r"\bpylint\b", None),
    ("lint", "flake8", r"\bflake8\b", None),
    ("lint", "clippy", r"\bclippy\b|cargo\s+clippy\b", None),
    ("lint", "golint", r"\bgolangci-lint\b|golint\b", None),
    ("lint", "rubocop", r"\brubocop\b", None),
    ("lint", "shellcheck", r"\bshellcheck\b", None),
    ("lint", "hadolint", r"\bhadolint\b", None),
    ("typecheck", "mypy", r"\bmypy\b", None),
    ("typecheck", "pyright", r"\bpyright\b|npx\s+pyright\b", None),
    ("typecheck", "tsc_check", r"\btsc\s+.*--noEmit\b|tsc\b.*--noEmit", None),
    ("typecheck", "flow", r"\bflow\b", None),
    ("typecheck", "cargo_check", r"\bcargo\s+check\b", None),
    ("format", "black", r"\bblack\b(?:\s+--check)?", None),
    ("format", "prettier", r"\bprettier\b|npx\s+prettier\b", None),
    ("format", "isort", r"\bisort\b", None),
    ("format", "rustfmt", r"\brustfmt\b|cargo\s+fmt\b", None),
    ("format", "gofmt", r"\bgofmt\b|goimports\b", None),
)
OUTPUT_FAILS = r"FAIL(?:ED|URE)?|ERROR|(?:\d+)\s+(?:failed|errors?|failures?)|AssertionError|panic|SEGFAULT|(?:Build|Compilation)\s+(?:failed|error)"
OUTPUT_PASSES = r"(?:\d+)\s+passed|(?:All\s+)?tests?\s+passed|OK\s*$|Build\s+succeeded|0\s+(?:errors?|failures?|failed)"
# --- fixed values: signs of injected instructions, characters that are not seen, and secrets in questions, without regard to case ---
INJECTIONS = (
    ("ignore_prev", r"ignore\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+instructions?"),
    ("disregard_prev", r"disregard\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|prompts?)"),
    ("sys_override", r"system\s+prompt\s+(?:override|replace|reset)"),
    ("deception", r"do\s+not\s+(?:tell|inform|reveal\s+to)\s+the\s+user"),
    ("role_reset", r"you\s+are\s+now\s+(?:a|an|the)\s+"),
    ("fake_role_tag", r"</?\s*(?:system|assistant)\s*>"),
    ("fake_section", r"\bBEGIN\s+(?:NEW\s+)?(?:SYSTEM|INSTRUCTIONS?)\b"),
)
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
QUESTION_SECRETS = r"(sk-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{36}|AKIA[0-9A-Z]{16}|password\s*[:=]\s*\S+|secret\s*[:=]\s*\S+|api[_-]?key\s*[:=]\s*\S+)"
# --- fixed values: languages and weights of tokens by the end of a path ---
LANGUAGES = (
    ("python", (".py", ".pyi")), ("rust", (".rs",)), ("javascript", (".js",)), ("typescript", (".ts", ".tsx")), ("javascript", (".jsx",)), ("go", (".go",)), ("java", (".java",)), ("kotlin", (".kt",)),
    ("ruby", (".rb",)), ("sql", (".sql",)), ("bash", (".sh",)), ("yaml", (".yaml", ".yml")), ("toml", (".toml",)), ("json", (".json",)), ("markdown", (".md",)), ("c", (".c",)), ("cpp", (".cpp",)), ("c", (".h",)), ("cpp", (".hpp",)),
)
TOKEN_WEIGHTS = (
    (1.0, (
        ".go", ".py", ".pyw", ".rs", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".mts", ".cjs", ".cts", ".java", ".kt", ".scala", ".cs", ".csx", ".fs", ".swift", ".cpp", ".cc", ".c", ".h", ".hpp", ".hxx",
        ".rb", ".php", ".ex", ".exs", ".dart", ".lua", ".zig", ".vue", ".svelte",
    )),
    (3.0, (".yaml", ".yml", ".json", ".toml")),
    (2.0, (".md", ".rst")),
    (2.0, (".sh", ".bash", ".zsh", ".dockerfile")),
    (1.3, (".sql",)),
)
OTHER_TOKEN_WEIGHT = 1.5
# --- fixed values: words without weight in searches of notes and of sentences ---
SEARCH_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "to",
    "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "and", "but", "or", "not", "no", "if", "then", "than", "that", "this", "it", "its", "we", "you", "he", "she",
    "they", "my", "your", "how", "what", "which", "where", "when", "who", "does", "about",
)
SENTENCE_STOP_WORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "with", "by", "how", "does", "what", "why", "is", "are", "and", "or", "but", "do", "between", "two", "include", "shown", "actual", "actually", "that",
    "this", "these", "those", "from", "can", "could", "should", "would", "has", "have", "had", "will", "was", "were", "been", "being", "about", "into", "through", "over", "under", "above", "below", "after",
    "before", "while", "when", "where", "not", "no", "yes", "all", "any", "some", "most", "many", "much", "more", "less", "than", "then", "thus", "therefore", "you", "your", "their", "his", "her", "its",
    "our", "it", "he", "she", "they", "them", "we", "us", "i", "me", "my",
)
