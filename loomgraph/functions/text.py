"""Column builders over names, paths and texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and path parts that decide roles, noise and entry points.
TEST_PARTS = ["test", "tests", "__tests__"]
TEST_SUFFIXES = [
    "_test.py", "_test.go", "_test.rs", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".spec.mjs",
    ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".test.mjs",
]
LOW_SIGNAL_KINDS = ["element", "selector", "class_selector", "id_selector", "json_key"]
CALLABLE_KINDS = ["function", "method", "anonymous_function", "trait_method", "constructor"]
MODULE_ROOTS = ["src", "app", "apps", "packages", "services", "modules", "libs", "lib", "crates"]
BOILERPLATE_NAMES = ["__init__", "__main__"]
BOILERPLATE_TESTS = ["__init__.py", "conftest.py", "__init__.pyi"]
NOISE_TEXTS = ["public/monaco-editor/", ".min.js", ".bundle.js", ".generated.", ".d.ts"]
NOISE_PARTS = ["monaco-editor", "vendor", "third_party", "third-party", "node_modules", ".next", "dist", "build", ".cache"]
ENTRY_PATHS = [
    "main.py", "app.py", "manage.py", "run.py", "server.py", "main.go", "cmd/main.go", "src/main.rs", "src/lib.rs",
    "src/main.ts", "src/index.ts", "src/main.tsx", "src/index.tsx", "src/main.js", "src/index.js", "index.ts", "index.js",
]
ENTRY_ENDINGS = ["src/main.tsx", "src/main.ts", "src/index.tsx", "src/index.ts", "src/main.js", "src/index.js", "main.rs", "lib.rs"]
AREA_ROOTS = ["src", "app", "lib"]
UI_PARTS = ["/components/", "/pages/", "/views/"]
STATE_PARTS = ["/stores/", "/hooks/"]
BACKEND_PARTS = ["/server/", "/routes/", "/api/"]
CONFIG_ENDINGS = [".config.ts", ".config.js", ".config.tsx", "package.json"]
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "tsx", ".mts": "typescript", ".cts": "typescript", ".go": "go", ".rs": "rust",
    ".html": "html", ".htm": "html", ".css": "css", ".json": "json", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
    ".cs": "c_sharp", ".php": "php", ".phtml": "php", ".rb": "ruby",
}
VISIBILITY_RANKS = {"exported": 3, "public": 2, "private": 1}
KIND_RANKS = {
    "class": 4, "function": 3, "method": 3, "anonymous_function": 2, "struct": 4, "interface": 4, "trait": 4, "enum": 4, "module": 3,
}
EDGE_WEIGHTS = {"import": 0.35, "call": 0.50, "precise": 0.55}


def tokens(text: Column) -> Column:
    """Lower-cased identifier-like tokens, Unicode letters and digits included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w_][\w\d_]*)"), F.lit(1))


def identifier_parts(name: Column) -> Column:
    """Parts of a camel-case, snake-case or path-like name, lower-cased."""
    spaced = F.regexp_replace(name, "_|-|::", " ")
    parts = F.regexp_extract_all(spaced, F.lit(r"([A-Z][a-z0-9]+|[a-z0-9]+|[A-Z0-9]+(?=[A-Z]|$))"), F.lit(1))
    return F.transform(parts, lambda p: F.lower(p))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def bare_name(path: Column) -> Column:
    """The stem without the marks of a test: ``test_``, ``_test``, ``.test``, ``.spec``."""
    name = stem(path)
    return F.when(name.rlike(r"(?s).(\.test|\.spec|_test)$"), F.regexp_replace(name, r"(\.test|\.spec|_test)$", "")).otherwise(
        F.when(name.rlike("(?s)^test_."), F.substring(name, 6, 100_000)).otherwise(name))


def is_test_file(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    folder = F.arrays_overlap(parts, F.array(*[F.lit(p) for p in TEST_PARTS]))
    name = F.element_at(parts, -1)
    named = name.startswith("test_")
    for suffix in TEST_SUFFIXES:
        named = named | name.endswith(suffix)
    return folder | named


def is_boilerplate_test(path: Column) -> Column:
    """Package marks and fixture files, which test nothing."""
    return file_name(path).isin(BOILERPLATE_TESTS)


def is_noise_file(path: Column) -> Column:
    """Built, bundled or vendored files."""
    low = F.lower(path)
    inside = F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(p) for p in NOISE_PARTS]))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in NOISE_TEXTS], inside)


def is_entry_point(path: Column) -> Column:
    """Files where a program customarily starts."""
    return reduce(lambda a, b: a | b, [path.endswith(e) for e in ENTRY_ENDINGS], path.isin(ENTRY_PATHS))


def glob_pattern(glob: str) -> str:
    """A shell pattern over a whole path as a regular expression: ``*`` and ``?`` match slashes too."""
    parts = re.split(r"(\*|\?|\[!?[^]]+\])", glob)
    known = {"*": ".*", "?": "."}
    made = [known.get(x, "[" + x[1:-1].replace("\\", "\\\\").replace("!", "^", 1 if x[1] == "!" else 0) + "]" if x[:1] == "[" and x[-1:] == "]" else re.escape(x)) for x in parts]
    return "(?s)^" + "".join(made) + "$"


def fits_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


def at_least(level_: Column, threshold: str) -> Column:
    """Whether a level reaches a threshold of LOW, MED (MEDIUM) and HIGH."""
    rank = lambda x: F.when(x == "HIGH", 3).when(x.isin("MED", "MEDIUM"), 2).when(x == "LOW", 1).otherwise(0)
    return rank(F.upper(level_)) >= rank(F.lit(threshold.upper()))


def impact_area(path: Column) -> Column:
    """The top folder of a path, below a customary source folder; null at the root."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.when(F.element_at(parts, 1).isin(AREA_ROOTS), F.element_at(parts, 2)).otherwise(F.element_at(parts, 1)))


def language(path: Column) -> Column:
    """The language of a file by its ending; null if unknown."""
    ending = F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ending)


def module_path(path: Column) -> Column:
    """A path without its ending; the folder of an index file."""
    folder = parent(path)
    base = F.when(folder == "", stem(path)).otherwise(F.concat(folder, F.lit("/"), stem(path)))
    return F.when(stem(path) == "index", F.when(folder == "", ".").otherwise(folder)).otherwise(base)


def share_test_dir(test: Column, target: Column) -> Column:
    """Whether a test lies beside its target, or in a test folder beside it; not at the root."""
    a, b = parent(test), parent(target)
    above = F.regexp_extract(a, r"^(.*)/(?:__tests__|tests|test)$", 1)
    return (b != "") & ((a == b) | (above == b))


def age_seconds(iso: Column, now: Column) -> Column:
    """Seconds from an ISO-8601 time to another time; null where it is none."""
    return F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(iso))


def under_prefix(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix or lies below it, by whole segments."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


def module_bucket(path: Column) -> Column:
    """``(root)``, the first part, or the first two below a customary source folder."""
    parts = F.split(path, "/")
    first = F.element_at(parts, 1)
    deep = first.isin(MODULE_ROOTS) & (F.size(parts) > 2)
    return F.when(F.size(parts) == 1, "(root)").when(deep, F.concat_ws("/", first, F.element_at(parts, 2))).otherwise(first)


def signal_weight(kind: Column, name: Column, visibility: Column) -> Column:
    """How much a symbol counts: markup little, customary names less, private names a bit less."""
    return (
        F.when(kind.isin(LOW_SIGNAL_KINDS), 0.002)
        .when(name.isin(BOILERPLATE_NAMES), 0.35)
        .when(name.startswith("_") & (visibility == "private"), 0.85)
        .otherwise(1.0)
    )


def route_template(path: Column) -> Column:
    """``:name`` as ``{name}``."""
    return F.regexp_replace(path, r":(\w+)", r"{$1}")


def route_pattern(template: Column) -> Column:
    """A template as a regular expression: each ``{name}`` is one path segment."""
    return F.concat(F.lit("^"), F.regexp_replace(template, r"\{[^}]*\}", "[^/]+"), F.lit("$"))


def level(score: Column, high: float, medium: float, names: tuple[str, str, str] = ("high", "medium", "low")) -> Column:
    return F.when(score >= high, names[0]).when(score >= medium, names[1]).otherwise(names[2])


def file_role(path: Column, exported: Column, classes: Column, functions: Column, symbols: Column) -> Column:
    """The role of a file by its path, else by the numbers of its symbols: ``classes`` and
    ``functions`` are the larger of the numbers of classes and interfaces, functions and methods."""
    low = F.lower(path)
    within = lambda parts: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])
    return (
        F.when(is_test_file(path), "test")
        .when(within(UI_PARTS), "frontend-ui")
        .when(within(STATE_PARTS), "frontend-state")
        .when(within(BACKEND_PARTS) | low.startswith("server/"), "backend")
        .when(reduce(lambda a, b: a | b, [low.endswith(e) for e in CONFIG_ENDINGS]), "config")
        .when(exported >= 3, "core").when(classes >= 2, "model").when(functions >= 3, "service").when(symbols >= 10, "core")
        .otherwise("other")
    )
