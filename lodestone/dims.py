"""Fixed lists of the security domain: dimension tables small enough to be unrolled into expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities with score, rank and SARIF level.
SEVERITIES = [("CRITICAL", 10, 0, "error"), ("HIGH", 8, 1, "error"), ("MEDIUM", 5, 2, "warning"), ("LOW", 3, 3, "note"), ("INFO", 1, 4, "note")]

# Confidence assumed where none is given, by severity.
ASSUMED_CONFIDENCE = {"CRITICAL": 0.95, "HIGH": 0.90, "MEDIUM": 0.80, "LOW": 0.70, "INFO": 0.60}

# Calls that are dangerous with untrusted input, by category.
SINKS = {
    "sql": ["cursor.execute", "db.execute", "db.query", "connection.execute", "conn.execute", "pool.query", "sequelize.query", "knex.raw", "prisma.$queryRaw", "prisma.$executeRaw"],
    "command": ["os.system", "os.popen", "subprocess.run", "subprocess.call", "subprocess.Popen", "exec", "child_process.exec", "child_process.spawn", "child_process.execSync", "child_process.execFile"],
    "code": ["eval", "exec", "Function(", "setTimeout(", "setInterval(", "vm.runInNewContext", "vm.runInThisContext"],
    "path": ["fs.readFile", "fs.writeFile", "fs.readFileSync", "fs.writeFileSync", "fs.unlink", "fs.unlinkSync", "open(", "os.path.join", "path.join", "path.resolve"],
    "randomness": ["Math.random", "random.random", "random.randint"],
    "xss": ["res.send", "res.write", "document.write", "innerHTML", "dangerouslySetInnerHTML", "render("],
    "deserialization": ["pickle.loads", "yaml.load", "JSON.parse", "unserialize"],
    "ssrf": ["requests.get", "requests.post", "fetch(", "axios.get", "axios.post", "http.get", "urllib.request.urlopen"],
}

# Where untrusted input enters.
SOURCES = [
    "request.body", "request.args", "request.form", "request.params", "request.query", "request.headers", "request.cookies", "req.body", "req.query", "req.params", "req.headers", "req.cookies",
    "request.GET", "request.POST", "request.FILES", "req.json()", "request.json()", "await req.json()", "searchParams", "params", "request.files", "req.file", "req.files", "message.data", "ws.on('message'", "process.env", "os.environ",
]

# Calls that neutralise input.
SANITIZERS = [
    "parseInt", "parseFloat", "Number(", "Boolean(", "int(", "float(", "str(", "encodeURIComponent", "encodeURI", "escape(", "html.escape", "markupsafe.escape", "bcrypt.hash", "bcrypt.compare",
    "crypto.createHash", "hashlib.sha256", "hashlib.md5", "validator.isEmail", "validator.isURL", "DOMPurify.sanitize", "xss(", "prisma.", "sequelize.", "mongoose.",
]

# Words in names of entry points.
ENTRY_WORDS = ["get", "post", "put", "delete", "patch", "handler", "route", "endpoint", "view", "main", "app", "index"]

# Which files are scanned.
EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".json", ".yaml", ".yml", ".xml", ".sql", ".sh", ".bash", ".dockerfile", ".tf", ".hcl"]
SKIPPED_DIRECTORIES = [".git", "node_modules", "venv", ".venv", "env", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs", ".next", ".nuxt", "vendor", "third_party"]
PATTERN_SKIPPED = ["node_modules", ".git", "dist", "build", ".next", "__pycache__", "coverage"]
MANIFESTS = ["package.json", "package-lock.json", "yarn.lock", "requirements.txt", "Pipfile", "Pipfile.lock", "pyproject.toml", "go.mod", "go.sum", "Gemfile", "Gemfile.lock", "pom.xml", "build.gradle", "composer.json", "composer.lock", "Cargo.toml", "Cargo.lock"]
MERGE_EXEMPT = [*MANIFESTS, "pnpm-lock.yaml", "requirements.in", "poetry.lock", "setup.py", "setup.cfg"]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pipfile.lock", "poetry.lock", "composer.lock"]
PRIORITY_FILES = ["main.py", "app.py", "index.js", "server.js", "main.go", "app.rb", "index.ts", "main.java"]
SECURITY_WORDS = ["route", "auth", "login", "middleware", "password", "upload", "admin", "api", "config", "webhook", "payment", "token", "session", "otp", "verify", "reset", "signup", "register"]
CONFIG_NAMES = [
    "settings.py", "local.py", "production.py", "staging.py", "base.py", "config.py", "conf.py", "next.config.js", "next.config.ts", "next.config.mjs", "nuxt.config.js", "nuxt.config.ts", "vite.config.js", "vite.config.ts",
    "webpack.config.js", "server.js", "server.ts", "app.js", "app.ts", "Dockerfile", "Dockerfile.production", "docker-compose.yml", "docker-compose.yaml", "docker-compose.production.yml", "nginx.conf", ".htaccess", ".gitlab-ci.yml",
]
CONFIG_DIRECTORIES = ["settings", "config", "conf", "deploy", "infra"]
FRAMEWORKS = {"django": "django", "flask": "flask", "fastapi": "fastapi", "express": "express", "nextjs": "next", "react": "react", "vue": "vue", "angular": "angular", "spring": "spring", "rails": "rails"}
LANGUAGES = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".go": "Go", ".rb": "Ruby", ".php": "PHP", ".cs": "C#"}
TEST_MARKS = ["/test/", "/tests/", "/__tests__/", "/spec/", "/mock/", "/mocks/", "/fixtures/", "/testdata/", "/test_data/", "/examples/", "/demo/", ".test.", ".spec.", "_test.", "test_", "conftest.", "/e2e/"]
FENCE_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "php": "php", "rb": "ruby", "rs": "rust", "c": "c", "cpp": "cpp",
    "h": "c", "cs": "csharp", "yml": "yaml", "yaml": "yaml", "json": "json", "html": "html", "htm": "html", "xml": "xml", "sh": "bash", "bash": "bash", "sql": "sql", "dockerfile": "dockerfile",
}

# Class of weakness by the words of a title, first match first.
CWE_BY_TITLE = [
    ("sql injection", "CWE-89", "A03:2021 Injection"), ("nosql injection", "CWE-943", "A03:2021 Injection"), ("command injection", "CWE-78", "A03:2021 Injection"), ("path traversal", "CWE-22", "A01:2021 Broken Access Control"),
    ("xss", "CWE-79", "A03:2021 Injection"), ("ssrf", "CWE-918", "A10:2021 SSRF"), ("hardcoded secret", "CWE-798", "A07:2021 Auth Failures"), ("broken auth", "CWE-287", "A07:2021 Auth Failures"),
    ("broken access", "CWE-284", "A01:2021 Broken Access Control"), ("prototype pollution", "CWE-1321", "A03:2021 Injection"), ("jwt weak", "CWE-347", "A02:2021 Crypto Failures"), ("insecure deserialization", "CWE-502", "A08:2021 Software Integrity"),
    ("vulnerable dependency", "CWE-1395", "A06:2021 Vulnerable Components"), ("crypto failure", "CWE-327", "A02:2021 Crypto Failures"), ("open redirect", "CWE-601", "A01:2021 Broken Access Control"), ("xxe", "CWE-611", "A05:2021 Security Misconfig"),
    ("idor", "CWE-639", "A01:2021 Broken Access Control"), ("race condition", "CWE-362", "A04:2021 Insecure Design"), ("auth bypass", "CWE-287", "A07:2021 Auth Failures"), ("missing rate limit", "CWE-307", "A07:2021 Auth Failures"),
    ("info exposure", "CWE-209", "A05:2021 Security Misconfig"), ("insecure cookie", "CWE-614", "A05:2021 Security Misconfig"), ("weak password", "CWE-521", "A07:2021 Auth Failures"), ("user enumeration", "CWE-204", "A07:2021 Auth Failures"),
    ("insecure randomness", "CWE-330", "A02:2021 Crypto Failures"),
]


class Rule(NamedTuple):
    id: str
    title: str
    severity: str
    cwe: str
    owasp: str
    regex: str
    #: The regex for engines without look-around, and what it must not hold.
    plain: str
    extensions: tuple[str, ...]
    context: tuple[str, ...]
    absent: tuple[str, ...] = ()


_WEB = (".ts", ".js", ".tsx", ".jsx")
# Patterns, extensions and context words of the scanner's rules.
RULES = [
    Rule("hardcoded-otp-bypass", "One-time code fixed in source", "CRITICAL", "CWE-287", "A07:2021", r"""['"](?:111111|123456|000000|999999|112233|654321)['"]""", "", (*_WEB, ".py"), ("otp", "verify", "auth", "login", "code", "fallback", "bypass")),
    Rule("hardcoded-dev-password", "Development password fixed in source", "CRITICAL", "CWE-798", "A07:2021", r"""(?:password|passwd|secret|token)\s*(?:===?|!==?|=)\s*['"](?:admin|password|test|dev|123456|qwerty|secret|changeme)['"]""", "", (*_WEB, ".py"), ("auth", "login", "password", "admin", "verify")),
    Rule("insecure-random-otp", "Predictable random number for a secret", "MEDIUM", "CWE-330", "A02:2021", r"""Math\.random\s*\(\s*\)""", "", _WEB, ("otp", "token", "code", "id", "random", "generate", "uuid")),
    Rule("stack-trace-leak", "Stack trace in a response", "HIGH", "CWE-209", "A04:2021", r"""(?:error\.stack|err\.stack|\.stack\b)(?!Trace)""", r"""(?:error\.stack|err\.stack|\.stack\b)""", _WEB, ("response", "json", "return", "res.", "NextResponse", "send")),
    Rule("user-enumeration", "Reply tells whether an account exists", "MEDIUM", "CWE-204", "A07:2021", r"""['"](?:User not found|Account not found|Email not found|No user|No account|Phone not registered|User does not exist|Invalid email)['"]""", "", (*_WEB, ".py"), ("login", "auth", "signin", "sign-in", "authenticate")),
    Rule("weak-password-length-only", "Password rule checks the length only", "MEDIUM", "CWE-521", "A07:2021", r"""(?<!confirm)(?:password|newPassword|new_password)(?:\.length|\.len\b)\s*(?:<|<=|>|>=)\s*\d+""", r"""(?:password|newPassword|new_password)(?:\.length|\.len\b)\s*(?:<|<=|>|>=)\s*\d+""", (".ts", ".js", ".py"), ("password", "reset", "change", "register", "signup")),
    Rule("missing-auth-api-route", "Route changes data without an identity check", "HIGH", "CWE-306", "A01:2021", r"""(?:export\s+async\s+function\s+(?:POST|PUT|PATCH|DELETE))|(?:app\.(?:post|put|patch|delete)\s*\()""", "", (".ts", ".js"), ("admin", "approve", "delete", "update", "create"),
         ("verifyAccessToken", "getServerSession", "auth(", "authenticate", "requireAuth", "withAuth", "isAuthenticated", "jwt", "bearer", "authorization", "cookie", "session")),
    Rule("env-var-fallback-secret", "Secret setting with a literal default", "CRITICAL", "CWE-798", "A07:2021", r"""(?:os\.environ\.get\s*\(\s*['"][^'"]*(?:PASSWORD|SECRET|KEY|TOKEN)[^'"]*['"]\s*,\s*['"][^'"]+['"]\s*\))|(?:process\.env\.\w*(?:PASSWORD|SECRET|KEY|TOKEN)\w*\s*\|\|\s*['"][^'"]+['"])""", "", (".py", ".js", ".ts"), ("password", "secret", "key", "token", "credential", "api")),
]


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEVERITIES, "severity string, score int, rank int, sarif_level string")


def by_severity(severity: Column, values: dict[str, object], other: object) -> Column:
    out = F.lit(other)
    for name, v in reversed(values.items()):
        out = F.when(severity == name, F.lit(v)).otherwise(out)
    return out


def score_of(severity: Column) -> Column:
    return by_severity(severity, {s: n for s, n, _, _ in SEVERITIES}, 0)


def rank_of(severity: Column) -> Column:
    return by_severity(severity, {s: r for s, _, r, _ in SEVERITIES}, 9)
