"""Predicates and texts of commands and their outputs, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of commands that tell little, that depend on their machine, and of mismatches (fixed values).
TRIVIAL = r"^((ls|pwd|whoami|date)(\s|$)|(echo|cat|head|tail|wc)(\s|$)|git\s+status(\s|$))"
BROAD_TEST = r"^(?:python\s+-m\s+)?(?:pytest|npm\s+(?:run\s+)?test|pnpm\s+test|yarn\s+test|go\s+test|pants\s+test|(?:bazelisk|bazel)\s+test)(\s|$)"
SWEEP = r"\s\/\/\.\.\.(\s|$)"
TARGETED = r"(\s-k\s+\S+|\s--maxfail(?:=|\s)\d+|\s--filter\s+\S+|\s--grep\s+\S+|\s--\s+--\S+|\/|::)"
MACHINE_BOUND = r"(sys\.path\s*=\s*\[p\s+for\s+p\s+in\s+sys\.path\s+if\s+p\s+not\s+in\s*\(''\s*,\s*os\.getcwd\(\)\)\]|django\.__file__|\/swebench_pi_workspaces_)"
MISMATCH = r"(command not found|not recognized as an internal or external command|no such file or directory|file not found|cannot find module|no module named|module not found|modulenotfounderror|importerror|unknown option|unknown argument|unrecognized argument|missing required argument|permission denied|executable file not found|no matches found|could not locate)"
#: Words that say nothing of a command (fixed values).
GENERIC = ("npm", "npx", "pnpm", "yarn", "bun", "node", "python", "python3", "bash", "cd", "run", "test", "build", "lint", "check", "info", "error", "command", "exited", "code", "output", "checked", "files", "fixed", "found", "line", "lines", "src", "dist")


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def low_signal(command: Column) -> Column:
    """A trivial command, or a test command that sweeps everything or names no target."""
    c = F.lower(strip(command))
    return (c != "") & (c.rlike(TRIVIAL) | c.rlike(BROAD_TEST) & (c.rlike(SWEEP) | ~c.rlike(TARGETED)))


def machine_bound(command: Column) -> Column:
    """A command whose replay depends on the machine it ran on."""
    return command.rlike(f"(?i){MACHINE_BOUND}")


def mismatch(command: Column, text: Column) -> Column:
    """Signs of a command or an environment that did not match."""
    return F.concat_ws("\n", command, text).rlike(f"(?i){MISMATCH}")


def keywords(text: Column) -> Column:
    """The distinct telling words in order: letters and digits only, 3 to 32 of them, not all digits, not generic."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w).between(3, 32) & ~w.rlike("^[0-9]+$") & ~w.isin(*GENERIC)))


def expected_phrases(failed: Column, fixed: Column, text: Column, most: int = 3) -> Column:
    """What a fix brought: words of its command that the failed one had not (else all), then words of its text."""
    new = F.array_except(keywords(fixed), keywords(failed))
    return F.slice(F.array_distinct(F.concat(F.when(F.size(new) > 0, new).otherwise(keywords(fixed)), keywords(text))), 1, most)


def query_text(output: Column, command: Column, most: int = 280) -> Column:
    """First line of a failure and its command, white space collapsed, cut with an ellipsis."""
    first = F.split(output, r"\r?\n")[0]
    t = F.trim(F.regexp_replace(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(command, F.lit(""))), r"\s+", " "))
    return clip(t, most, "…", trim_end=True)


def clip(text: Column, most: int, mark: str, within: int = 0, trim_end: bool = False) -> Column:
    """A longer text cut to `most` - `within` characters and marked."""
    cut = F.substring(text, 1, most - within)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(cut, r"\s+$", "") if trim_end else cut, F.lit(mark)))


def hint_signature(text: Column) -> Column:
    """Lower case without hex words, white space collapsed, 160 characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\b[0-9a-f]{8,}\b", ""), r"\s+", " ")), 1, 160)


def patch_paths(text: Column) -> Column:
    """The distinct files that the headers of a patch name, in order."""
    lines = F.transform(F.split(text, r"\r?\n"), strip)
    return F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(r"^diff --git a/.+? b/.+$")), lambda x: strip(F.regexp_extract(x, r"^diff --git a/(.+?) b/(.+)$", 2))))


def string_list(text: Column) -> Column:
    """A list given as a JSON array of strings, or by commas and line ends."""
    listed = F.from_json(text, "array<string>")
    parts = F.filter(F.transform(F.split(text, "[,\n]"), strip), lambda x: x != "")
    return F.when(strip(text).startswith("[") & listed.isNotNull(), listed).otherwise(parts)


def final_status(text: Column) -> Column:
    """The status that a run reports of itself, the last one it names: success, partial or blocked."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"final_status:\s*(success|partial|blocked)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))
