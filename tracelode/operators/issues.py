"""Issue classification of failures by ordered patterns, tool surfaces, hints and their policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the classifier (fixed values).
PROBES = ("curl", "wget", "http", "fetch", "jq", "rg", "ripgrep", "grep")
NO_PROBE = r"\b(playwright|preview|build|deploy|merge|add-iam-policy-binding|domain-mappings)\b"
PROBE_FAILURE = r"(\b404\b|not found|no matches? found|no result|does not exist|command exited with code 1|jq: (?:parse )?error|parse error:|invalid numeric literal)"
GATE_COMMAND = r"\b(npm\s+run\s+eval:|tsx\s+scripts\/run-(?:observed-ab|trajectory-outcome)-(?:gate|long-horizon)\.ts)\b"
GATE_OUTPUT = r"(gate pass:\s*false|gate failures:|family-disjoint pair constraint:)"
CHECKS_COMMAND = r"\bgh\s+pr\s+checks\b"
CHECKS_OUTPUT = r"no checks reported on the '.*' branch"
TRANSIENT = r"(timed out|timeout|connection reset|connection refused|temporarily unavailable|rate limit|429\b|\b50[234]\b|network is unreachable|tls handshake timeout|upstream)"
TRACEBACK = r"traceback \(most recent call last\):"
TRACEBACK_COMMAND = r"(generate_vertex_image\.py|vertex|post_linear_comment\.py|scripts\/search\.py|scripts\/content\.py|uploads\.linear\.app|api\.linear\.app)"
COMMAND_MISMATCH = r"(unknown option|unrecognized option|invalid option|invalid argument|usage:\s|did you mean .*--|without specifying a condition to a policy containing conditions is prohibited|run the command again with .*--condition|cannot use .* without specifying|syntax error near unexpected token|not allowed in a regex)"
ENVIRONMENT_MISMATCH = r"(permission denied|command not found|executable file not found|executable doesn't exist|cannot find module|cannot find package|err_module_not_found|module not found|no such file or directory|missing dependency|denied by policy|externally-managed-environment|pw_run\.sh|ms-playwright)"
MISSING_CONTEXT = r"""(undefined variable|is not defined|cannot read properties of undefined|null pointer|keyerror|attributeerror|typeerror|syntaxerror|error ts|traceback \(most recent call last\)|base branch policy prohibits the merge|auto merge is not allowed|could not resolve to a repository|host_mismatch|ownership_missing|provided domain does not appear to be verified|credentials are no longer valid|authentication error|firebase login|reauthentication failed|cannot prompt during non-interactive execution|cloud domains api has not been used|some errors were emitted while running checks|some errors were emitted while applying fixes|"errors":\s*\[|"error":\s*\{|"message":\s*"not found"|"status":\s*"error"|(bearer_token|api[_-]?key|token|credentials).*missing|find: .*no such file or directory|ls: .*no such file or directory|permission denied for table)"""
AUTH_OUTPUT = r"(http\s*40[13]\b|forbidden|unauthorized|api post .* failed: http\s*400\b)"
AUTH_COMMAND = r"(search_console_report\.py|searchconsole\.googleapis\.com|firebase_hosting_deploy\.py|firebasehosting\.googleapis\.com|gcloud\s+projects\s+add-iam-policy-binding|gcloud\s+beta\s+run\s+domain-mappings\s+create|gh\s+repo\s+view|gh\s+pr\s+merge)"
HARMFUL = ("command_mismatch", "missing_context", "environment_mismatch")
KINDS = ("benign_probe", "command_mismatch", "environment_mismatch", "missing_context", "transient_external", "unknown_failure")
#: Tool surfaces by the first word of a command (fixed values); any other is `other`.
SURFACES = (
    ("gcloud", "cloud:gcloud"), ("gh", "git:github_cli"), ("git", "git"), ("terraform", "infra:terraform"), ("pants", "build:pants"), ("kubectl", "k8s"), ("helm", "k8s"), ("docker", "container:docker"),
    *((w, "js-toolchain") for w in ("npm", "npx", "pnpm", "yarn", "node", "bun")), *((w, "python-toolchain") for w in ("python", "python3", "pip", "pip3", "uv", "pytest")), *((w, "go-toolchain") for w in ("go", "gofmt", "goimports")),
    *((w, "http-probe") for w in ("curl", "wget", "http")), *((w, "shell") for w in ("rg", "grep", "find", "ls", "bash", "zsh", "sh")),
)


def normalized(text: Column) -> Column:
    """Lower case without colour codes, hex runs masked, white space collapsed."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text, r"\u001b\[[0-9;]*m", "")), "[0-9a-f]{8,}", "<hex>")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))


def is_probe(command: Column) -> Column:
    """Whether the last part of a command line begins with a looking-up tool and nothing of it builds or deploys."""
    line = F.lower(strip(command))
    parts = F.filter(F.transform(F.split(line, r"&&|\|\||;"), strip), lambda x: x != "")
    first = F.split(F.coalesce(F.try_element_at(parts, F.lit(-1)), line), r"\s+")[0]
    return first.isin(*PROBES) & ~line.rlike(NO_PROBE)


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def classify(command: Column, output: Column) -> Column:
    """struct(kind, harmful, confidence, abstained) of a failure: the first rule that holds decides."""
    both = F.concat(normalized(command), F.lit("\n"), normalized(output))
    says = lambda text, pattern: text.rlike(f"(?i){pattern}")
    bare = strip(output)
    silent = (bare == "") | bare.startswith("(no output)")
    rules = (
        (says(both, TRANSIENT) | says(output, TRACEBACK) & says(command, TRACEBACK_COMMAND), "transient_external", 0.84),
        (says(command, GATE_COMMAND) & says(output, GATE_OUTPUT), "benign_probe", 0.80),
        (says(command, CHECKS_COMMAND) & says(output, CHECKS_OUTPUT), "benign_probe", 0.78),
        (is_probe(command) & ((bare == "") | (bare == "(no output)") | says(output, PROBE_FAILURE)), "benign_probe", 0.82),
        (says(both, COMMAND_MISMATCH), "command_mismatch", 0.90),
        (says(both, MISSING_CONTEXT) | says(output, AUTH_OUTPUT) & says(command, AUTH_COMMAND), "missing_context", 0.78),
        (says(both, ENVIRONMENT_MISMATCH), "environment_mismatch", 0.86),
        (silent, "environment_mismatch", 0.55),
    )
    make = lambda kind, confidence: F.struct(F.lit(kind).alias("kind"), F.lit(kind in HARMFUL).alias("harmful"), F.lit(confidence).alias("confidence"), F.lit(kind == "unknown_failure").alias("abstained"))
    out = F.when(rules[0][0], make(*rules[0][1:]))
    for test, kind, confidence in rules[1:]:
        out = out.when(test, make(kind, confidence))
    return out.otherwise(make("unknown_failure", 0.35))


def tool_surface(command: Column) -> Column:
    """The surface of a command's first word."""
    first = F.split(F.trim(command), " ")[0]
    out = F.when(first == SURFACES[0][0], SURFACES[0][1])
    for word, surface in SURFACES[1:]:
        out = out.when(first == word, surface)
    return out.otherwise("other")


def match_rules(texts: DataFrame, rules: list[tuple[str, str, float, int]], text: str = "text") -> DataFrame:
    """hint_id and confidence of the best rule of each text: highest confidence, then lowest priority; texts without one go.

    `rules` are (hint_id, pattern, confidence, priority), a list of the caller. In their order of preference they make one
    chain of conditions, so a text is read until its best rule holds, and nothing is joined.
    """
    out = None
    for hint, pattern, confidence, _ in sorted(rules, key=lambda r: (-r[2], r[3])):
        test, hit = F.col(text).rlike(pattern), F.struct(F.lit(hint).alias("hint_id"), F.lit(confidence).alias("confidence"))
        out = F.when(test, hit) if out is None else out.when(test, hit)
    if out is None:
        out = F.lit(None).cast("struct<hint_id: string, confidence: double>")
    return texts.withColumn("_hit", out).filter("_hit is not null").select("*", "_hit.hint_id", "_hit.confidence").drop("_hit")


def harmful_rate(harmful: Column, failures: Column, prior_harmful: float = 1.0, prior_n: float = 4.0) -> Column:
    """A rate smoothed by prior counts."""
    return (harmful + F.lit(prior_harmful)) / (failures + F.lit(prior_n))


def bandit(reduction: Column, total: Column, n: Column) -> Column:
    """Reduction plus a bonus for what was tried little."""
    return reduction + 0.04 * F.sqrt(F.log(total + 1) / (n + 1))
