"""Names, orders, labels and limits that results depend on."""

# Directories that a tree walk never enters (any other dot-directory is skipped as well).
TREE_IGNORED_DIRS = [
    ".git", "node_modules", ".venv", "venv", "target", "bin",
    "obj", "out", "dist", "build", "gradle", ".idea", ".vscode", "__pycache__",
]

# File suffixes that a tree walk drops.
TREE_IGNORED_SUFFIXES = [
    ".pyc", ".png", ".jpg", ".jpeg", ".ico", ".svg", ".zip", ".tar.gz", ".lock",
]

# Directory names excluded from look-ups by base name, per profile.
LOOKUP_IGNORED_DIRS = [
    "node_modules", ".venv", "target", "bin", "obj", "dist", "build", "__pycache__",
]
REPAIR_IGNORED_DIRS = [
    "node_modules", ".venv", "target", "bin", "obj", "dist", "build", "__pycache__", ".git",
]
PYTHON_IGNORED_PARTS = [".venv", "__pycache__"]
GENERIC_IGNORED_DIRS = ["node_modules", "__pycache__", ".venv", "dist", "build"]

# Extension preference when an import names no extension.
RESOLVE_EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".rs", ".rb", ".go", ".cs", ".cpp", ".h",
]
ALIAS_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py"]
RELATED_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ""]

# Manifest files sampled at the repository root, in output order.
CONFIG_FILES = [
    "package.json", "Cargo.toml", "Gemfile", "go.mod", "pom.xml", "build.gradle",
    "requirements.txt",
]

# Module names and directories that mark Python routes.
ROUTE_STEMS = ["routes", "router", "views", "api", "handlers", "endpoints"]
ROUTE_DIRS = ["routes", "api", "views", "handlers"]
GENERIC_SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".py"]

# HTTP verbs in report order.
GENERIC_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH"]
TS_VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD"]

# Auth labels in order of precedence: (label, words that must all occur, words of which one must occur).
AUTH_RULES_GENERIC = [
    ("Depends(get_current_user)", ["get_current_user", "Depends"], []),
    ("requireAuth + verifyUserIdMatch", ["requireAuth", "verifyUserIdMatch"], []),
    ("requireAuth", ["requireAuth"], []),
    ("getServerSession", ["getServerSession"], []),
    ("auth()", [], []),
    ("login_required", ["login_required"], []),
    ("jwt_required", ["jwt_required"], []),
    ("verifyToken", ["verifyToken"], []),
    ("authorize", ["authorize"], []),
    ("authenticate", ["authenticate"], []),
]
AUTH_RULES_TS = [
    ("requireAuth + verifyUserIdMatch", ["requireAuth", "verifyUserIdMatch"], []),
    ("requireAuth", ["requireAuth"], []),
    ("getServerSession", ["getServerSession"], []),
    ("auth()", [], []),
    ("verifyToken", ["verifyToken"], []),
]
AUTH_RULES_PY = [
    ("Depends(get_current_user)", ["get_current_user", "Depends"], []),
    ("login_required", ["login_required"], []),
    ("jwt_required", ["jwt_required"], []),
    ("verify_token", ["verify_token"], []),
    ("requireAuth", ["requireAuth"], []),
]

# Dependency type by words in the lower-cased path, first hit wins, else "service".
STEM_TYPE_RULES = [
    ("util", ["util", "helper"]),
    ("api_route", ["controller", "route", "handler", "api"]),
    ("database", ["model", "schema", "db", "entity"]),
    ("config", ["config"]),
]
# Dependency type of an aliased import by path part, first hit wins, else "util".
ALIAS_TYPE_RULES = [
    ("api_route", ["/api/"]),
    ("service", ["/service", "/provider"]),
    ("config", ["/config"]),
    ("database", ["/lib/", "/supabase"]),
    ("prompt", ["/prompt"]),
    ("type", ["/type"]),
    ("hook", ["/hook"]),
    ("component", ["/component"]),
]

# Texts that appear in results.
TOO_BROAD_MESSAGE = (
    "Your query is too broad. Please specify a narrower set of features (up to 3 specs)."
)
OFFLINE_SUMMARY = "Ollama is offline. Skipped batch summary."
PAYLOAD_WARNING = (
    "\n\n[WARNING: Response truncated to 50,000 characters to maintain protocol stability"
    " and prevent context bloating.]"
)

# Sizes that flags and throttles go by.
MAX_COMMIT_FILES = 50
COMMIT_BATCH = 5
PAYLOAD_CHARS = 50_000
THROTTLE_SECONDS = 300
