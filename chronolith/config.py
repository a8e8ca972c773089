"""Settings of the engine and the fixed pattern lists."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

SCALES = ("weekly", "monthly", "quarterly", "yearly")
ROOT_MODULE = "(root)"

# Source file extensions.
SOURCE_EXTENSIONS = (
    ".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".kt", ".kts", ".go", ".rs", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".rb", ".php",
    ".swift", ".scala", ".m", ".mm", ".dart", ".lua", ".pl", ".sh", ".sql",
)
# Paths that are never source.
IGNORED_PATHS = (
    r"(^|/)node_modules/", r"(^|/)vendor/", r"(^|/)third_party/", r"(^|/)dist/", r"(^|/)build/", r"(^|/)target/", r"(^|/)\.git/", r"(^|/)__pycache__/",
    r"\.min\.(js|css)$", r"\.lock$", r"(^|/)package-lock\.json$", r"(^|/)yarn\.lock$", r"(^|/)poetry\.lock$", r"(^|/)Pipfile\.lock$", r"(^|/)go\.sum$",
    r"(^|/)Cargo\.lock$", r"\.(png|jpg|jpeg|gif|svg|ico|pdf|zip|gz|tar|jar|woff2?|ttf|eot|mp4|mp3)$", r"(^|/)(\.idea|\.vscode)/", r"\.generated\.",
    r"_pb2\.py$", r"\.pb\.go$", r"(^|/)migrations/\d+_", r"\.snap$",
)
# Modules of tests, whose imports bear no load.
TEST_MODULES = (r"(^|/)(tests?|__tests__|spec|specs|testing|e2e|fixtures?)(/|$)", r"(^|/)test_[^/]+$")
# Authors that are bots, tested on "author <email>" whatever the case.
BOT_AUTHORS = (r"\[bot\]$", "dependabot", "renovate", "greenkeeper", "github-actions", "snyk-bot", "pre-commit-ci", "codecov", "semantic-release", "imgbot")
# Subjects of maintenance commits, whatever the case.
NOISE_SUBJECTS = (
    r"^(chore|build|ci)\(deps(-dev)?\)", r"^bump ", r"\bbump(ed|ing)? (version|deps|dependencies)\b", r"^(chore: )?update dependenc", r"^\[?auto\]?[- ]?format",
    r"^(style|chore): (format|lint|prettier|black)", r"^apply (black|prettier|isort|clang-format)", r"^(re)?generated? ", r"^merge (branch|pull request)",
    r"^release v?\d", r"^version bump", r"^\[skip ci\]",
)
# Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".scala": "scala", ".m": "objc", ".mm": "objc", ".dart": "dart", ".lua": "lua",
    ".pl": "perl", ".sh": "shell", ".sql": "sql",
}
# Endings that an import target may lack.
IMPORT_ENDINGS = ("", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".kt", "/__init__.py", "/index.ts", "/index.js", "/mod.rs")
# Sizes of an update step (files, label).
STEP_SIZES = ((0, "0"), (3, "1-3"), (10, "4-10"), (50, "11-50"), (10**9, "51+"))


@dataclass(frozen=True)
class Settings:
    """The defaults."""

    scale: str = "monthly"
    module_depth: int = 2
    strip_prefixes: tuple[str, ...] = ("src", "lib", "app", "pkg", "packages")
    max_modules: int = 30  # changesets with more modules are not coupled
    max_files: int = 500  # commits with more files are bulk changes
    half_life: float = 4.0  # of coupling, in periods
    min_weight: float = 1.0
    top_partners: int = 5
    window: int = 8  # closed periods of the trend test
    min_periods: int = 4
    low_churn: float = 1.0  # commits a period
    recent: int = 4  # periods that must be calm, and over which the level is taken
    alpha: float = 0.10
    bearing_fan_in: int = 1
    bearing_partners: int = 2
    small_addition: int = 10
    large_addition: int = 100
    escalation_count: int = 3
    escalation_hours: float = 24.0

    @property
    def memory(self) -> int:
        """Periods before the recent ones in which authors are remembered."""
        return max(3 * self.window, 2 * self.recent)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Unknown names are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self))
