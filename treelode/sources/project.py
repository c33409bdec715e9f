"""Project root, settings files and the fixed scan rules. Small driver-side reads only."""
from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow.fs as pafs

# What is scanned by default.
CODE_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".php", ".html", ".css", ".astro", ".vue", ".svelte",
    ".scss", ".less", ".json", ".yaml", ".yml", ".sql", ".graphql", ".gql", ".prisma", ".toml",
)
DOC_EXTENSIONS = (".md", ".mdx")
DEFAULT_INCLUDE = ("src/**", "packages/**", "supabase/**", "docs/**", "apps/**", "cerebro-batch/src/**")
DEFAULT_EXCLUDE = (
    "node_modules/**", "dist/**", ".git/**", ".vectors/**", "**/*.test.ts", "**/*.test.tsx", "**/*.spec.ts",
    "**/*.spec.tsx", "**/*.d.ts", "**/*.generated.ts", "**/database.types.ts", "**/*.min.js", "**/*.map",
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml",
    "**/.env*", "**/secrets.*", "**/credentials.*", "**/*.pem", "**/*.key", "**/*.cert", "**/*.p12", "**/*.pfx",
    "**/*.keystore",
)
RC_FILE = ".treeloderc"
CONFIG_FILE = ".vectorconfig.json"
IGNORE_FILES = (".gitignore", ".vectorignore")
# Ignore rules that come last, so no file of the project can lift them.
ALWAYS_IGNORED = (
    "node_modules", ".git", ".vectors", RC_FILE, "dist",
    ".env*", "secrets.*", "credentials.*", "*.pem", "*.key", "*.cert", "*.p12", "*.pfx", "*.keystore",
)


def find_project_root(start: str) -> str:
    """Nearest directory upwards that holds `.git`; the start itself when there is none."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if folder != folder.parent and (folder / ".git").exists():
            return str(folder)
    return str(here)


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a local path or a URI."""
    if "://" in root:
        filesystem, path = pafs.FileSystem.from_uri(root)
        return filesystem, path.rstrip("/")
    return pafs.LocalFileSystem(), str(Path(root).resolve())


def root_uri(root: str) -> str:
    """The same root as Spark and Hadoop name it."""
    return root.rstrip("/") if "://" in root else Path(root).resolve().as_uri()


def read_text(root: str, name: str) -> str | None:
    """A file below the root, or None when it cannot be read."""
    filesystem, base = open_root(root)
    try:
        with filesystem.open_input_stream(f"{base}/{name}") as stream:
            return stream.read().decode("utf-8", "replace")
    except OSError:
        return None


@dataclass(frozen=True)
class Config:
    """`chunk_strategy` is read and kept but selects nothing."""

    include: tuple[str, ...] = DEFAULT_INCLUDE
    exclude: tuple[str, ...] = DEFAULT_EXCLUDE
    chunk_strategy: str = "ast"


def load_config(root: str) -> Config:
    """A key that is given replaces its default; an unreadable file means all defaults."""
    try:
        given = json.loads(read_text(root, CONFIG_FILE) or "{}")
    except ValueError:
        given = {}
    if not isinstance(given, dict):
        given = {}

    def pick(key, default):
        return default if given.get(key) is None else given[key]

    return Config(tuple(pick("include", DEFAULT_INCLUDE)), tuple(pick("exclude", DEFAULT_EXCLUDE)),
                  pick("chunkStrategy", "ast"))


@dataclass
class Rc:
    auto_index: bool = field(default=False)


def parse_rc(text: str) -> Rc:
    """KEY=VALUE lines; the last auto_index wins and only the word true is true."""
    rc = Rc()
    for line in text.split("\n"):
        key, equals, value = line.strip().partition("=")
        if equals and not key.startswith("#") and key.strip() == "auto_index":
            rc.auto_index = value.strip() == "true"
    return rc


def load_rc(root: str) -> Rc:
    return parse_rc(read_text(root, RC_FILE) or "")


def save_rc(root: str, rc: Rc) -> None:
    """Write the whole settings file anew."""
    filesystem, base = open_root(root)
    text = ("# treelode settings\n# auto_index=true indexes changed files whenever a scheduler calls auto_index\n"
            f"auto_index={'true' if rc.auto_index else 'false'}\n")
    with filesystem.open_output_stream(f"{base}/{RC_FILE}") as stream:
        stream.write(text.encode())


def ignore_lines(root: str) -> list[str]:
    """Lines of the ignore files at the root, then the rules that always hold."""
    found = [line for name in IGNORE_FILES for line in (read_text(root, name) or "").split("\n")]
    return [*found, *ALWAYS_IGNORED]
